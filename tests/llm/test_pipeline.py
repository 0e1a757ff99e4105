import re
from collections import Counter

import pytest

import corpus_pipeline
from test_packing import plain as plain_bins
from test_simhash import plain_components, plain_fingerprint
from willowfold.llm import packing


def test_stages_against_plain_versions(spark, documents):
    # a document that language ID rejects, an exact copy but for white space, and an empty text
    extra = documents.limit(1).selectExpr("900001L AS doc_id", "'?! 123' AS text", "lang", "source", "n_chars")
    copy = documents.where("doc_id = 3").selectExpr("900002L AS doc_id", "replace(text, ' ', '  ') AS text", "lang", "source", "n_chars")
    docs = documents.unionByName(extra).unionByName(copy)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {d: t for d, t in rows.items() if t and any(map(str.isalpha, t))}
    first = {}
    for d in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", kept[d]), d)
    kept = {d: kept[d] for d in first.values()}
    ids = sorted(kept)
    comps = plain_components([(d, plain_fingerprint(kept[d])) for d in ids])
    kept = {d: kept[d] for d, c in zip(ids, comps, strict=True) if d == c}
    got = docs
    for name, stage in corpus_pipeline.STAGES:
        before = got
        got = stage(spark, got, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert got.columns == before.columns
    pieces = got.collect()
    assert {r.doc_id for r in pieces} == set(kept)
    lengths = [r.length for r in pieces]
    assert sum(lengths) == sum(len(t.encode()) + 1 for t in kept.values())
    bins = {r.bin_id: (r.bin_size, r.bin_used) for r in pieces}
    assert Counter(bins.values()) == plain_bins(lengths, packing.SIZES)


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns[:3] == ["doc_id", "piece", "start"] and got.count() > 0


def test_rows_are_decided_one_by_one(spark, documents):
    base = [(r.doc_id, r.text, r.lang) for r in documents.where("doc_id < 40").collect()]
    a, b, c = base[0], base[1], base[2]
    extra = [
        a, a,  # repeated rows
        (None, b[1], "en"), (None, "?! 1", "en"), (None, None, None),  # null ids: a copy, two rejected rows
        (c[0], "?! 2", c[2]), (c[0], a[1], c[2]),  # an id of a clean row with a rejected text and with a copy of another row
        (None, "the and of " + c[1][::-1], "en"), (None, "the and of " + c[1][::-1], "en"),  # a group without any id
    ]
    docs = spark.createDataFrame([(*r, "s", 1) for r in base + extra], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.identify(spark, docs, "")
    rejected = [r for r in base + extra if not (r[1] and any(map(str.isalpha, r[1])))]
    assert got.columns == docs.columns and not {r.text for r in got.collect()} & {r[1] for r in rejected}
    assert got.count() >= docs.count() - len(rejected) - 2
    clean = docs.where("text is not null and text not like '?!%'")
    norm = {}
    for d, t, _ in base + extra:
        if t and not t.startswith("?!"):
            norm.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), []).append(d)
    want = sorted((min((d for d in ids if d is not None), default=-1), t) for t, ids in norm.items())
    exact = corpus_pipeline.drop_copies(spark, clean, "")
    assert sorted((-1 if r.doc_id is None else r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text)) for r in exact.collect()) == want
    rows = sorted(((d if d is not None else 1 << 62, t) for d, t, _ in base + extra if t and not t.startswith("?!")), key=lambda r: r[0])
    comps = plain_components([(i, plain_fingerprint(t)) for i, (_, t) in enumerate(rows)])
    near = corpus_pipeline.drop_near_copies(spark, clean, "")
    assert near.columns == docs.columns and near.count() == len(set(comps))
    assert sorted(r.doc_id if r.doc_id is not None else 1 << 62 for r in near.collect()) == sorted(rows[c][0] for c in set(comps))


def test_a_table_without_labels_is_kept(spark, documents):
    docs = documents.where("doc_id < 50").selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars")
    with pytest.warns(UserWarning, match="no row has a label"):
        kept = corpus_pipeline.identify(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_empty_table_through_all_stages(spark, documents):
    got = documents.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, got, "")
        assert got.count() == 0, name
