import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from willowfold.llm import spelling

def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    """Variants of (id, text) rows, comparing every two words."""
    count = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    return plain_words(words)


def plain_words(words):
    forms = {}
    for w, n in words.items():
        near = [x for x in words if one_apart(w, x)]
        best = min(((-words[x], x) for x in near), default=None)
        forms[w] = (best[1] if best and -best[0] >= 2 * n else None, len(near))
    found = {}
    for w, (form, n_near) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        found[w] = (form, root, words[w], n_near, words[form] if form else None)
    return found


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_documents_against_plain(spark, documents):
    docs = documents.where("doc_id < 90")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = spelling.of_documents(docs)
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "string", "bigint", "bigint", "bigint"]
    assert len(want) > 300 and rows_of(got) == want


@pytest.mark.parametrize("limit", [2, 8, spelling.LIMIT])
def test_dense_words_against_all_pairs(spark, limit, monkeypatch):
    rng = random.Random(4)
    words = {"".join(rng.choices("abé", k=rng.randint(5, 8))): rng.choice([3, 3, 4, 7, 9, 20, 50, 400]) for _ in range(700)}
    words |= {"z" * 3000 + tail: 5 for tail in ("", "a", "ab", "b", "zb")} | {"hello" + c: 3 for c in "abcdefghijklmnopqrstuvwxyzÿ×"} | {"hello": 7}
    table = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert rows_of(spelling.variants(table, limit=limit)) == plain_words(words)
    sizes = spelling.blocks(table, limit).groupBy("key", "size").count().collect()
    assert all(r["count"] <= max(limit, 64) for r in sizes)  # letters here: at most 28, pairs of letters 9


def test_odd_rows(spark, odd, nothing):
    assert spelling.of_documents(nothing).count() == 0
    assert rows_of(spelling.of_documents(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])


def test_runs_are_whole(spark):
    table = spark.createDataFrame([(1, "abcd ABCDE-fÉè×÷x9abcdef Āabcdeg a\U0001f600bcdefg", "x")], "doc_id long, text string, run string")
    assert [r.run for r in spelling.runs_of(table).collect()] == ["abcde", "fÉè×÷x", "abcdef", "abcdeg", "bcdefg"]


def test_slips_lose_the_named_letter(spark):
    pairs = [(i, w) for i in range(40) for w in ("letter", "étéwords", "passages")]
    table = spark.createDataFrame(pairs, "doc_id long, text string")
    got = sorted(r.w for r in spelling.runs_of(table).select(spelling.slipped(F.col("run"), F.col("id")).alias("w")).collect())
    want = []
    for i, w in pairs:
        h = zlib.crc32(f"{i}:{w}".encode())
        want.append(w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w)
    assert got == sorted(want) and want != [w for _, w in pairs]
