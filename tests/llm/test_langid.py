import base64
import random

import numpy as np

import pytest

from willowfold.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    got = langid.predict(docs, model).join(docs.where(langid.held_out()).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    # clean documents are kept
    assert langid.predict(docs, model).where("rejected").count() == 0


def test_frequencies_cover_all_learning_rows(documents):
    model = langid.fit(documents)
    rows = [langid.counts(r.text) > 0 for r in documents.collect()]
    want = np.log((1 + len(rows)) / (1 + np.sum(rows, axis=0))) + 1
    assert np.allclose(model.idf, want, rtol=1e-5)
    assert set(model.languages) == {"de", "en", "es", "fr"}


def test_prediction_is_the_nearest_centroid(documents):
    model = langid.fit(documents)
    texts = [r.text for r in documents.collect()]
    near = langid.vectors([langid.counts(t) for t in texts], model.idf) @ model.centroids.T
    for (lang, score, _), row in zip(model.predict(texts), near, strict=True):
        assert abs(score - row.max()) < 1e-6 and abs(row[[x == lang for x in model.languages]].max() - row.max()) < 1e-6


def test_rejection_and_odd_rows(odd, nothing):
    model = langid.fit(odd)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect() if r.doc_id is not None}
    for d in (3, 4, 5, 6):
        assert got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected
    assert not got[1].rejected and got[1].lang_pred == "en"
    kept = langid.drop_rejected(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} >= {1, 2, 7, 8, 10}
    assert langid.predict(nothing, langid.fit(nothing)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}
    strict = langid.Model(model.idf, model.centroids, model.languages, max_distance=0.1)
    assert strict.predict(["zzqx qqzx xxqz"])[0][2]


def test_unlearned_languages_are_rejected_at_any_length(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"):
        for words in (5, 50, 500, 5000):
            texts = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(words)) for _ in range(5)]
            assert all(rejected for _, _, rejected in model.predict(texts)), (letters, words)
    junk = [base64.b64encode(rng.randbytes(rng.randint(20, 300))).decode() for _ in range(100)] + [rng.randbytes(rng.randint(20, 100)).hex() for _ in range(50)]
    junk += ["for (int i = 0; i < n; i++) { total += values[i] * weight[i]; }", "SELECT a.id, count(*) FROM t1 a JOIN t2 b ON a.id = b.ref GROUP BY a.id HAVING count(*) > 3;", "$ sudo apt-get -y install libssl-dev && make -j8"]
    junk += ["import os, sys; print(os.path.join(sys.argv[1], 'a.txt'))", "var el = document.getElementById('x'); el.addEventListener('click', e => { e.preventDefault(); });"]
    assert np.mean([rejected for _, _, rejected in model.predict(junk)]) >= 0.95
    # the beginnings of learned languages stay, however short
    texts = [r.text for r in docs.where(langid.held_out()).select("text").limit(100).collect()]
    for words in (5, 20, 100):
        assert not any(rejected for _, _, rejected in model.predict([" ".join(t.split()[:words]) for t in texts])), words


def test_bars_by_length():
    held = np.zeros((langid.CLASSES, langid.BINS), np.int64)
    held[4, 200], held[8, 0], held[8, 600], held[10, 500] = 50, 1, 3000, 10
    bars = langid.bars_of({"en": held})["en"]
    assert bars[:4] == [0, 0, 0, 0] and np.allclose(bars[4:8], 0.06) and np.allclose(bars[8:], 0.15)


def test_too_many_labels_are_refused(spark):
    rows = [(i, f"some words {i}", f"label{i}") for i in range(langid.MAX_LANGUAGES + 5)]
    with pytest.raises(ValueError, match="different labels"):
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
