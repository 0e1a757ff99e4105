import hashlib
import re

from willowfold.llm import exact_dedup


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def check(docs, **kw):
    rows = [(r.doc_id, norm(r.text)) for r in docs.select("doc_id", "text").collect()]
    groups = {}
    for d, t in rows:
        groups.setdefault(t, []).append(d)
    got = sorted(map(tuple, exact_dedup.exact_groups(docs, **kw).collect()), key=str)
    want = []
    for d, t in rows:
        ids = [i for i in groups[t] if i is not None]
        keep = min(ids) if ids else None
        n = len(groups[t])
        want.append((d, keep, n, (n == 1) if d is None else d == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_against_plain_groups(documents):
    check(documents)


def test_splits_and_overfull_buckets(documents):
    check(documents, capacity=7)
    check(documents, capacity=7, bits=6)
    check(documents, capacity=1, bits=1)


def test_directory_doubles_until_buckets_fit(spark, documents):
    filled = spark.createDataFrame([(0, 5), (1, 2), (4, 1)], "slot int, n long")
    assert {tuple(r) for r in exact_dedup.directory(filled, 4, 3).collect()} == {(0, 3, 0), (1, 3, 1), (4, 1, 1)}
    index = exact_dedup.build_index(exact_dedup.entries_of(documents, "doc_id", "text"), capacity=16).collect()
    held = {}
    for r in index:
        assert r.bucket == (r.h & (1 << 64) - 1) >> (64 - r.depth) if r.depth else r.bucket == 0
        held.setdefault((r.depth, r.bucket), []).append(r)
    assert len(held) > 8 and max(map(len, held.values())) <= 16
    assert sum(r.copies for r in index) == documents.count() and all(r.chained == (r.copies > 1) for r in index)


def test_chains_need_no_shuffle_of_their_own(spark, documents):
    folded = spark.createDataFrame([(0, 1)], "first_slot long, h long").repartitionByRange("first_slot")
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    plan = folded.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("first_slot", "h")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_odd_rows(odd, nothing):
    check(odd)
    assert exact_dedup.exact_groups(nothing).count() == 0
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect() if r.doc_id} == {1, 3, 5, 6, 7, 8, 9, 10, 11}
