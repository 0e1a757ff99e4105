import itertools
import random
import zlib

from pyspark.sql import functions as F

from willowfold.llm import reshard


def test_flow_is_least():
    rng = random.Random(1)
    for _ in range(40):
        shards, old = rng.randint(1, 4), rng.randint(1, 4)
        rows = {s: sorted(rng.randint(1, 9) for _ in range(rng.randint(1, 7))) for s in range(old)}
        held = {s: len(r) for s, r in rows.items()}
        base, extra = divmod(sum(held.values()), shards)
        must = {s: max(0, n - base - 1) if s < shards else n for s, n in held.items()}
        spare = {s: r[must[s]] for s, r in rows.items() if must[s] < len(r)}
        moves = reshard.transfers(held, shards, spare, {s: sum(r[: must[s]]) for s, r in rows.items()})
        moved = {s: 0 for s in rows}
        counts = {t: held.get(t, 0) for t in range(shards)}
        for s, t, low, high in moves:
            assert low == moved[s] and s != t
            moved[s] += high - low + 1
            counts[t] += high - low + 1
            if s < shards:
                counts[s] -= high - low + 1
        assert max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == sum(held.values())
        cost = sum(sum(rows[s][: moved[s]]) for s in rows)
        least = min(
            sum(sum(r[: max(0, len(r) - cap[s])]) if s < shards else sum(r) for s, r in rows.items())
            for cap in ([base + (t in more) for t in range(shards)] for more in itertools.combinations(range(shards), extra))
        )
        assert cost == least


def check(docs, shards, old=None, **kw):
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit("")), F.col("n_chars") % 3), F.lit(7)) if old is None else old
    got = reshard.reshard(docs, old, shards, **kw).collect()
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    counts = [len(slots.pop(s, [])) for s in range(shards)]
    assert not slots and max(counts) - min(counts) <= 1
    return counts


def test_counts_are_even_and_rows_whole(documents):
    check(documents, 40)
    check(documents, 3, file_bytes=20_000)


def test_odd_rows(odd, nothing):
    check(odd, 4, tied_rows=1)
    assert reshard.reshard(nothing, F.lit(0), 4).count() == 0


def test_repeated_rows_keep_the_law(spark, documents):
    schema = "doc_id long, text string, source string, n_chars long, to_shard int"
    one = spark.createDataFrame([(7, "same text", "s", 1, 0)] * 1000 + [(i, "t" * (i % 50), "s", i, 0) for i in range(300)], schema)
    null = spark.createDataFrame([(None, "same text", "s", 1, 0)] * 500 + [(i, None, "s", i, 0) for i in range(5)], schema)
    assert min(check(one, 40)) > 0
    assert min(check(null, 40, tied_rows=10)) > 0
    some = documents.where("doc_id % 7 < 5")
    check(some.union(some).union(some), 40)


def test_only_changed_shards_are_written(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 9), i % 3 if i < 6 else 3, "extra") for i in range(12)], "doc_id long, text string, home int, shard string")
    path = str(tmp_path / "new")
    got = reshard.reshard(docs, F.col("home"), 4, path=path).collect()
    assert sorted(p.name for p in (tmp_path / "new").iterdir() if "=" in p.name) == [f"shard_={s}" for s in range(4)]
    back = spark.read.parquet(path)
    assert sorted(map(tuple, back.select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert {(r.doc_id, r.shard_) for r in back.collect()} == {(r.doc_id, r.shard) for r in got}
    # three shards are even already and one row is too many in none of them
    even = docs.where("home < 3")
    assert sorted((r.doc_id, r.shard) for r in reshard.reshard(even, F.col("home"), 3, path=str(tmp_path / "none")).collect()) == sorted((r.doc_id, r.home) for r in even.collect())
    assert not (tmp_path / "none").exists()
    two = spark.createDataFrame([(i, "x", s) for i, s in enumerate([0] * 4 + [1] * 2 + [2] * 3)], "doc_id long, text string, home int")
    assert check(two, 3, F.col("home"), path=str(tmp_path / "two")) == [3, 3, 3]
    assert sorted(p.name for p in (tmp_path / "two").iterdir() if "=" in p.name) == ["shard=0", "shard=1"]
