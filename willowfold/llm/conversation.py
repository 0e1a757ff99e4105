"""Repair of conversations: the cheapest edits that make a dialogue well formed, by a run-length dynamic program.

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``: at most one system message first, then user and
assistant by turns, ending with the assistant.  Edits of a row: keep (0), give it the role user or assistant (1), delete (2);
empty rows of user or assistant may be inserted anywhere (5 each).  Blank and duplicate rows must be deleted; a truncated row
that stays costs 5 more.  Of the cheapest series of edits the one whose initials (D, I, K, R) come first in ASCII is taken.

Method: a row is one of nine symbols: must go, or an initial of four kinds, whole or truncated.  Equal neighbours are one run.
Each symbol has a min-plus matrix over the four states of the pattern, inserts before the row included, whose entries hold the
cost and the least initials; its binary powers are made once and kept.  Two series of the same rows that are not equal never
begin with one another, since each ends with the letter of a row, so the least of a product is the product of the least.

Layout: equal rows of a turn are counted before anything is shuffled; rows are numbered in each conversation by ranges, and
dealt by CHUNK of them.  A chunk gives its matrix (costs and, for ties, the order of its series); matrices of a conversation
meet, 32 numbers for each CHUNK rows, and give each chunk its states at both ends; the chunk then unrolls its own choices.  So no task
holds a conversation, however long, but for the audit string and the digest, which are one value: the digest is made from a sorted
stream in bounded memory.

Defined results: null ids form one conversation; null roles and texts are one space; null turns come first; rows of one turn are taken by
role, then text, equal ones next to each other; an empty table gives none; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.llm.shared import numbered, small_batches, stash

CHUNK = 4096
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
#: States: nothing yet, after the system message, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SPOKEN = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,), "s": (START,)}
BLANK = r"[^\x20\x09-\x0D]"
WHOLE = r"[.!?][\x20\x09-\x0D]*\z"
MUST_GO = "x"

Cell = tuple[int, str] | None
Matrix = tuple[tuple[Cell, ...], ...]


def after(state: int, letter: str, initial: str) -> int:
    """The state behind an edit; initial is that of the row's own role."""
    return state if letter == "D" else SYSTEM if letter == "K" and initial == "s" else NEXT[state]


def _step(symbol: str) -> Matrix:
    """One row of a symbol, any inserts before it included."""
    initial, extra = symbol[0], TRUNCATED * symbol.endswith("-")
    rows = []
    for begin in range(4):
        best: list[Cell] = [None] * 4
        at = begin
        for inserts in range(3):  # a third insert comes back to where the first led
            options = [("D", DELETE)]
            if symbol != MUST_GO:
                options += [("R", REROLE + extra)] + [("K", extra)] * (at in SPOKEN.get(initial, ()))
            for letter, cost in options:
                end, found = after(at, letter, initial), (INSERT * inserts + cost, "I" * inserts + letter)
                best[end] = min(filter(None, (best[end], found)))
            at = NEXT[at]
        rows.append(tuple(best))
    return tuple(rows)


def _product(a: Matrix, b: Matrix) -> Matrix:
    def cell(i: int, j: int) -> Cell:
        ways = [(x[0] + y[0], x[1] + y[1]) for x, y in ((a[i][h], b[h][j]) for h in range(4)) if x and y]
        return min(ways, default=None)

    return tuple(tuple(cell(i, j) for j in range(4)) for i in range(4))


@cache  # nine symbols, a power for each bit of the longest run
def _power(symbol: str, bit: int) -> Matrix:
    return _step(symbol) if not bit else _product(_power(symbol, bit - 1), _power(symbol, bit - 1))


def run_matrix(symbol: str, length: int) -> Matrix:
    """length rows of a symbol, from the binary powers of one."""
    return reduce(_product, (_power(symbol, bit) for bit in range(length.bit_length()) if length >> bit & 1))


def _all(matrices: list[Matrix]) -> Matrix:
    """The product, taken in pairs so that series are joined a few times only."""
    while len(matrices) > 1:
        matrices = [_product(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


@lru_cache(maxsize=4096)
def _matrix_of(runs: tuple[tuple[str, int], ...]) -> Matrix:
    return _all([run_matrix(symbol, length) for symbol, length in runs])


def runs_of(rows: list[dict]) -> tuple[tuple[str, int], ...]:
    """(symbol, length) of a chunk's rows, n equal ones in each; all but a first whole or truncated one must go."""
    runs: list[list] = []
    for row in rows:
        parts = [(MUST_GO, row["n"])]
        if row["first"] and not row["blank"]:
            initial = row["initial"] if row["initial"] in ("s", "u", "a") else "o"
            parts = [(initial + "-" * row["truncated"], 1), (MUST_GO, row["n"] - 1)]
        for symbol, length in parts:
            if length and runs and runs[-1][0] == symbol:
                runs[-1][1] += length
            elif length:
                runs.append([symbol, length])
    return tuple((s, n) for s, n in runs)


def closing(state: int) -> int:
    """Inserts that end a conversation in this state."""
    return {SYSTEM: 2, USER: 1}.get(state, 0)


def route(costs: list[list[int]], orders: list[list[int]]) -> tuple[int, list[int]]:
    """(cost, states at the chunks' ends) of the first of the cheapest series through a conversation's chunks; costs and orders are 4 x 4 a chunk, -1 for no way."""
    ahead = [INSERT * closing(s) for s in range(4)]
    vectors = [ahead]
    for cost in reversed(costs):
        ahead = [min((cost[4 * i + j] + ahead[j] for j in range(4) if cost[4 * i + j] >= 0), default=1 << 60) for i in range(4)]
        vectors.append(ahead)
    states, at = [], START
    for cost, order, rest in zip(costs, orders, vectors[-2::-1], strict=True):
        at = min((cost[4 * at + j] + rest[j], order[4 * at + j], j) for j in range(4) if cost[4 * at + j] >= 0)[2]
        states.append(at)
    return vectors[-1][START], states


def _summed(rows: list[dict], matrix: Matrix) -> dict:
    """What a chunk tells of itself: its matrix, counts of faults and of pairs inside, and its ends."""
    costs, orders = [], []
    for line in matrix:
        ways = sorted(cell[1] for cell in line if cell)
        costs += [cell[0] if cell else -1 for cell in line]
        orders += [ways.index(cell[1]) if cell else -1 for cell in line]
    blank = sum(r["n"] for r in rows if r["blank"])
    good = [r for r in rows if r["first"] and not r["blank"]]
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    legal = sum(a["initial"] + b["initial"] in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return {
        "costs": costs, "orders": orders, "rows": sum(r["n"] for r in rows), "blank": blank, "duplicate": sum(r["n"] for r in rows) - blank - len(good), "truncated": sum(r["truncated"] for r in good), "legal": legal,
        "first_initial": rows[0]["initial"], "last_initial": rows[-1]["initial"], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
    }


_SUMMARY = "costs array<int>, orders array<int>, rows long, blank long, duplicate long, truncated long, legal long, first_initial string, last_initial string, first_turn long, last_turn long, turns long"


def _unrolled(rows: list[dict], letters: str, state: int) -> list[dict]:
    """The repaired rows of a chunk: (pos, sub, role, own): own rows keep their role if none is given, others are inserted."""
    made, at = [], 0
    for row in rows:
        n = row["n"]
        while n:
            letter = letters[at]
            state, before = after(state, letter, row["initial"]), state
            if letter != "D":
                spoken = "user" if NEXT[before] == USER else "assistant"
                made.append({"pos": row["pos"], "sub": len(made), "role": None if letter == "K" else spoken, "own": letter != "I"})
            n -= letter != "I"
            at += 1
    return made


def _mapped(df: DataFrame, made, schema: str, chunk: str) -> DataFrame:
    """df with what ``made`` gives for each row's list of narrow rows, in the columns of schema."""
    small_batches(df.sparkSession)
    fields = df.sparkSession.createDataFrame([], schema).toArrow().schema
    names, types = fields.names, fields.types
    keep = [c for c in df.columns if c != chunk]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [made(row) for row in batch.to_pylist()]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True)]], [*keep, *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != chunk)
    return df.mapInArrow(mapped, f"{kept}, {schema}")


def key_of(conv: Column) -> Column:
    """A key for each conversation that is never null."""
    return F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit(""))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by the CRC-32 of "conversation:turn" modulo 20: lost, emptied, without sentence ends, repeated, or said by the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn)).cast("binary")) % 20
    hit = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), h.alias("h")).where("h <> 0")
    text_ = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    n = F.when(F.col("h") == 3, 2).otherwise(1)
    return hit.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text_.alias("text"), F.explode(F.array_repeat(F.lit(0), n)).alias("_")).drop("_")


def _stored(rows: DataFrame) -> DataFrame:
    """(_conv, conv_id, turn, role, text, n, pos): different rows, counted and numbered in each conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(key_of(F.col("conv_id")).alias("_conv"), "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    counted = stash(own.groupBy("_conv", "conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")), "counted")
    by = ["_conv", "turn", "role", "text"]
    return numbered(counted.repartitionByRange(*by).sortWithinPartitions(*by), ["_conv"], "pos", "turns")


def _chunks(stored: DataFrame, size: int) -> DataFrame:
    """(_conv, chunk, rows): the narrow rows of every chunk in order."""
    narrow = stored.select(
        "_conv", "pos", "turn", "role", F.sha2("text", 256).alias("text_hash"), "n", F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(WHOLE)).alias("truncated"),
    )
    first = narrow.groupBy("_conv", "role", "text_hash").agg(F.min("pos").alias("pos")).select("_conv", "pos", F.lit(True).alias("first"))
    marked = narrow.join(first, ["_conv", "pos"], "left").select("_conv", "pos", "turn", "initial", "blank", "truncated", F.coalesce("first", F.lit(False)).alias("first"), "n")
    row = F.struct("pos", "turn", "initial", "blank", "truncated", "first", "n")
    grouped = marked.groupBy("_conv", F.floor(F.col("pos") / size).alias("chunk"))  # at most size rows a group
    return stash(grouped.agg(F.array_sort(F.collect_list(row)).alias("rows")), "chunks")


def _routes(chunks: DataFrame) -> DataFrame:
    """A row for each conversation: counts, cost, and the states at its chunks' ends."""
    told = _mapped(chunks.withColumnRenamed("rows", "list"), lambda r: _summed(r["list"], _matrix_of(runs_of(r["list"]))), _SUMMARY, "list")
    held = told.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct(*told.columns[1:]))).alias("parts"))

    def joined(row: dict) -> dict:
        parts = row["parts"]
        cost, states = route([p["costs"] for p in parts], [p["orders"] for p in parts])
        total = {n: sum(p[n] for p in parts) for n in ("rows", "blank", "duplicate", "truncated", "legal", "turns")}
        total["legal"] += sum(a["last_initial"] + b["first_initial"] in ("su", "ua", "au") for a, b in zip(parts, parts[1:], strict=False))
        spoken = [p for p in parts if p["turns"]]
        total["turns"] -= sum(a["last_turn"] == b["first_turn"] for a, b in zip(spoken, spoken[1:], strict=False))
        gaps = spoken[-1]["last_turn"] - spoken[0]["first_turn"] + 1 - total["turns"] if spoken else 0
        begins = [START, *states[:-1]]
        ends = [{"chunk": p["chunk"], "begin": b, "end": e, "closing": closing(e) * (p is parts[-1])} for p, b, e in zip(parts, begins, states, strict=True)]
        return {"gaps": gaps, "blank": total["blank"], "duplicate": total["duplicate"], "truncated": total["truncated"], "illegal": total["rows"] - 1 - total["legal"], "cost": cost, "ends": ends}

    schema = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, ends array<struct<chunk:long,begin:int,end:int,closing:int>>"
    return stash(_mapped(held, joined, schema, "parts"), "routes")


def _edits(chunks: DataFrame, routes: DataFrame) -> DataFrame:
    """(_conv, chunk, audit, made): each chunk's choices, unrolled."""
    ends = routes.select("_conv", F.explode("ends").alias("e")).select("_conv", "e.*")

    def chosen(row: dict) -> dict:
        rows = row["rows"]
        letters = _matrix_of(runs_of(rows))[row["begin"]][row["end"]][1]
        made, at = _unrolled(rows, letters, row["begin"]), row["end"]
        for _ in range(row["closing"]):
            at = NEXT[at]
            made.append({"pos": rows[-1]["pos"], "sub": len(made), "role": "user" if at == USER else "assistant", "own": False})
        return {"audit": letters + "I" * row["closing"], "made": made}

    joined = chunks.join(ends, ["_conv", "chunk"]).select("_conv", "chunk", "begin", "end", "closing", "rows")
    schema = "audit string, made array<struct<pos:long,sub:int,role:string,own:boolean>>"
    return stash(_mapped(joined, chosen, schema, "rows").select("_conv", "chunk", "audit", "made"), "edits")


def repair(rows: DataFrame, chunk_rows: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired rows of conversations (conv_id, turn, role, text).

    Report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), a row for each conversation with rows.
    Repaired rows: (conv_id, pos, sub, turn, role, text), in the order of pos and sub; inserted ones have no turn and an empty text.
    """
    stored = _stored(rows)
    chunks = _chunks(stored, chunk_rows)
    routes = _routes(chunks)
    edits = _edits(chunks, routes)
    audits = edits.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("chunk", "audit"))).alias("parts")).select("_conv", F.concat_ws("", F.col("parts.audit")).alias("audit"))
    ids = stored.groupBy("_conv").agg(F.first("conv_id").alias("conv_id"))
    report = routes.drop("ends").join(audits, "_conv").join(ids, "_conv").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    made = edits.select("_conv", F.inline("made")).withColumnRenamed("role", "new_role")
    texts = stored.select("_conv", "pos", "turn", "role", "text", F.lit(True).alias("own"))
    whole = made.where("own").drop("own").join(texts.drop("own"), ["_conv", "pos"])
    spoken = whole.select("_conv", "pos", "sub", "turn", F.coalesce("new_role", "role").alias("role"), "text")
    added = made.where("not own").select("_conv", "pos", "sub", F.lit(None).cast("long").alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    return report, spoken.unionByName(added).join(ids, "_conv").select("conv_id", "pos", "sub", "turn", "role", "text")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of the lines ``role:text`` of each conversation, read as one sorted stream."""
    lines = repaired.select(key_of(F.col("conv_id")).alias("_conv"), "pos", "sub", "conv_id", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition("_conv").sortWithinPartitions("_conv", "pos", "sub").select("_conv", "conv_id", "line")
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = ident = state = None
        for batch in batches:
            done = []
            for conv, own, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if conv != now:
                    if now is not None:
                        done.append((ident, state.hexdigest()))
                    now, ident, state = conv, own, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            kept = batch.schema.field(1).type
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in done], kept), pa.array([s for _, s in done], pa.string())], ["conv_id", "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ident], kept), pa.array([state.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    return lines.mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def reported(conversations: DataFrame, rows: DataFrame, chunk_rows: int = CHUNK) -> DataFrame:
    """The report with a digest, for every id of the original conversations; those without rows have zeros, an empty audit and the hash of nothing."""
    report, repaired = repair(rows, chunk_rows)
    keyed = lambda df: df.withColumn("_conv", key_of(F.col("conv_id")))
    ids = keyed(conversations.select("conv_id")).groupBy("_conv").agg(F.first("conv_id").alias("conv_id"))
    found = ids.join(keyed(report).drop("conv_id"), "_conv", "left").join(keyed(digests(repaired)).drop("conv_id"), "_conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


#: Forward, row by row: of every conversation the four states with cost, edits and repaired lines; CRC-32 bit by bit.
ORACLE = r"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')) AS k FROM conversations),
bytes AS (SELECT DISTINCT k, list_transform(range(octet_length(k)), lambda i: ('0x' || substr(hex(k), 2 * i + 1, 2))::UBIGINT) AS b FROM keyed),
crc AS (SELECT k, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda acc, x:
          list_reduce([xor(acc, x), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT) % 20 AS h FROM bytes),
hit AS (SELECT conv_id, turn, h, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM keyed JOIN crc USING (k) WHERE h <> 0),
copies AS (SELECT conv_id, turn, role, text FROM hit UNION ALL SELECT conv_id, turn, role, text FROM hit WHERE h = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM copies),
marked AS (SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
       row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
       lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
       count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated, count(*) FILTER (i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 1, 'u'), (1, 2, 1, 'u'), (2, 3, 1, 'a'), (3, 2, 1, 'u'),
                              (0, 3, 2, 'ua'), (1, 3, 2, 'ua'), (2, 2, 2, 'au'), (3, 3, 2, 'ua')) t(s, h, k, added)),
lines AS (SELECT *, list_transform(string_split(added, ''), lambda a: CASE a WHEN 'u' THEN 'user:' ELSE 'assistant:' END)[1:k] AS said FROM ins),
edit AS (SELECT * FROM (VALUES ('D', 0, 0), ('D', 1, 1), ('D', 2, 2), ('D', 3, 3), ('R', 0, 2), ('R', 1, 2), ('R', 2, 3), ('R', 3, 2),
                               ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)) t(e, h, j)),
dp AS (SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM told
       UNION ALL
       SELECT conv_id, i, j, (best).cost, (best).audit, (best).said FROM (
         SELECT d.conv_id, m.i, e.j, min({cost: d.cost + 5 * n.k + CASE e.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e.e <> 'D' AND m.cut THEN 5 ELSE 0 END,
                audit: d.audit || repeat('I', n.k) || CASE WHEN e.e IN ('D', 'R') THEN e.e ELSE 'K' END,
                said: list_concat(d.said, n.said, CASE e.e WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [CASE e.j WHEN 2 THEN 'user:' ELSE 'assistant:' END || m.text] ELSE [m.role || ':' || m.text] END)}) AS best
         FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1 JOIN lines n ON n.s = d.s
         JOIN edit e ON e.h = n.h AND (e.e = 'D' OR NOT (m.blank OR m.again) AND (e.e = 'R' OR e.e = m.c))
         GROUP BY d.conv_id, m.i, e.j)),
done AS (SELECT d.conv_id, min({cost: d.cost + 5 * n.k, audit: d.audit || repeat('I', n.k), said: list_concat(d.said, n.said)}) AS best
         FROM dp d JOIN told t ON t.conv_id IS NOT DISTINCT FROM d.conv_id AND d.i = t.n JOIN lines n ON n.s = d.s AND n.h IN (0, 3) GROUP BY d.conv_id)
SELECT o.conv_id, coalesce(t.gaps, 0) AS gaps, coalesce(t.blank, 0) AS blank, coalesce(t.duplicate, 0) AS duplicate, coalesce(t.truncated, 0) AS truncated, coalesce(t.illegal, 0) AS illegal,
       coalesce((d.best).cost, 0) AS cost, coalesce((d.best).audit, '') AS audit, sha256(coalesce(array_to_string((d.best).said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""
