import hashlib
import random
import zlib

import duckdb
import pytest

from willowfold.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, pos long, n int, chunk int"


def damaged(rows):
    """Plain damage: rows (conv, turn, role, text) by turn, then role and text."""
    found = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: text.translate({ord(c): None for c in ".!?"})}.get(h, text)
        found += [(conv, turn, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    return sorted(found, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plain(rows):
    """One conversation's report, by a search over all edits row by row that keeps every state's least series."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    space, seen, faults = " \t\n\v\f\r", set(), []
    for _, _, role, text in rows:
        bare = text.strip(space)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    front = {"": (0, "", [])}
    for (_, _, role, text), fault in [*zip(rows, faults, strict=True), ((None, None, "", ""), None)]:
        wide = dict(front)
        for last, (cost, audit, said) in front.items():
            for _ in range(3):
                last = nxt[last]
                cost, audit, said = cost + 5, audit + "I", [*said, ("user" if last == "u" else "assistant") + ":"]
                wide[last] = min(wide.get(last, (1 << 60,)), (cost, audit, said))
        if fault is None:
            front = wide
            break
        front = {}

        def put(last, *found):
            front[last] = min(front.get(last, (1 << 60,)), found)

        extra = 5 * (fault == "truncated")
        # every count of inserts, not the cheapest only: costs of a state may tie with other series
        for last, (cost, audit, said) in wide.items():
            put(last, cost + 2, audit + "D", said)
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] == nxt[last] or role[:1] == "s" and last == "":
                put(role[:1], cost + extra, audit + "K", [*said, f"{role}:{text}"])
            put(nxt[last], cost + 1 + extra, audit + "R", [*said, f"{'user' if nxt[last] == 'u' else 'assistant'}:{text}"])
    cost, audit, said = min(v for k, v in front.items() if k in ("", "a"))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def exhaustive(rows, symbols):
    """The least (cost, initials) over all series of edits with at most two inserts before a row."""
    best = None

    def go(i, state, cost, audit):
        nonlocal best
        if i == len(symbols):
            for k in range(3):
                if state in conversation.ENDS:
                    best = min(filter(None, (best, (cost + 5 * k, audit + "I" * k))))
                state = conversation.NEXT[state]
            return
        for k in range(3):
            base, a = cost + 5 * k, audit + "I" * k
            go(i + 1, state, base + 2, a + "D")
            if symbols[i] != "x":
                extra = 5 * symbols[i].endswith("-")
                go(i + 1, conversation.NEXT[state], base + 1 + extra, a + "R")
                if state in conversation.SPOKEN.get(symbols[i][0], ()):
                    go(i + 1, conversation.after(state, "K", symbols[i][0]), base + extra, a + "K")
            state = conversation.NEXT[state]

    go(0, conversation.START, 0, "")
    return best


def test_matrices_against_all_series():
    rng = random.Random(3)
    kinds = ["x", "s", "u", "a", "o", "s-", "u-", "a-", "o-"]
    for _ in range(150):
        symbols = [s for s in rng.choices(kinds, k=rng.randint(1, 3)) for _ in range(rng.randint(1, 2))][:4]
        want = exhaustive(None, symbols)
        whole = conversation._all([conversation.run_matrix(s, 1) for s in symbols])[0]
        assert want == min((c[0] + 5 * conversation.closing(j), c[1] + "I" * conversation.closing(j)) for j, c in enumerate(whole) if c)
    for kind in kinds:  # powers equal single steps
        assert conversation.run_matrix(kind, 13) == conversation._all([conversation.run_matrix(kind, 1)] * 13)


def odd_rows():
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        at = 0
        for _ in range(rng.randint(0, 9)):
            at += rng.choice([0, 1, 1, 1, 2])
            rows.append((conv, None if rng.random() < 0.1 else at, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "bot", "sage"]), rng.choice(["Yes.", "No", "So?", "", " \n", None, "Wait . ", "ö!", "yes"])))
    rows += [(900, i // 3, "user" if i % 2 else "assistant", f"line {i % 50}.") for i in range(700)]  # long, with ties and copies
    rows += [(901, None, "user", "same.")] * 1000
    rows += [(902, i, "user", f"{i}") for i in range(300)]
    return rows


@pytest.mark.parametrize("size", [7, conversation.CHUNK])
def test_against_plain(spark, size):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversation.reported(table, conversation.damage(table), size).collect()}
    convs = {r[0] for r in rows}
    assert set(got) == convs
    for conv in convs:
        assert got[conv] == plain(damaged([r for r in rows if r[0] == conv])), conv
    _, repaired = conversation.repair(conversation.damage(table), size)
    initials = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.pos, r.sub)):
        initials[r.conv_id] = initials.get(r.conv_id, "") + r.role[0]
    assert all(i.removeprefix("s").replace("ua", "") == "" and i for i in initials.values())


def test_empty(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert conversation.reported(table, conversation.damage(table)).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = spark.createDataFrame([(lost, 0, "user", "a.", 1, 1, 1)], SCHEMA)
    assert [tuple(r) for r in conversation.reported(table, conversation.damage(table)).collect()] == [(lost, *plain([]))]


def test_sql_says_the_same():
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    rows = [r for r in odd_rows() if r[0] is None or r[0] < 900]
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = {r[0]: r[1:] for r in con.execute(conversation.ORACLE).fetchall()}
    assert got == {conv: plain(damaged([r for r in rows if r[0] == conv])) for conv in {r[0] for r in rows}}
