import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from willowfold.llm import wavelet

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def test_rank_select_access():
    rng = np.random.default_rng(0)
    ids = rng.zipf(1.3, 3000).clip(0, 49407).astype(np.uint16)
    matrix = wavelet.WaveletMatrix.unpacked(len(ids), *wavelet.WaveletMatrix.of(ids, 16).packed())
    assert (matrix.ids(np.uint16) == ids).all()
    assert all(matrix.access(i) == ids[i] for i in range(0, 3000, 13))
    for value in (1, 2, 3, 7, 49407, 5000, 1 << 20):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places)
        assert matrix.count(value, 100, 2000) == ((places >= 100) & (places < 2000)).sum()
        assert [matrix.select(value, n) for n in range(0, len(places), 17)] == places[::17].tolist()
        assert matrix.select(value, len(places)) == -1
        assert matrix.places(value).tolist() == places.tolist()


def check(docs, **kw):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = wavelet.read_digests(wavelet.write(docs, PATH, 2, **kw)).collect()
    got = sorted(map(tuple, got), key=lambda r: r[1])
    assert [g[0] for g in got] == [d for d, _ in rows]
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = []
    for d, t in rows:
        ids = np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, len(ids), zlib.crc32(ids)))
    assert sorted(((d, n, c) for d, _, n, c in got), key=str) == sorted(want, key=str)


def test_files_give_the_ids_back(documents):
    check(documents)
    check(documents, shard_rows=37, segment_ids=2000)


def test_odd_rows(spark, odd, nothing):
    check(odd)
    check(odd, shard_rows=3)
    assert wavelet.read_digests(wavelet.write(nothing, PATH, 2)).count() == 0


def test_added_tokens_are_the_library_s_own(spark):
    texts = ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|>", "a <|endoftext|", "<|endoftext|>" * 3, "x<|Åendoftext|>", "<| endoftext |>", "plain"]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert wavelet.WordIds(PATH).encode(["hello <|endoftext|> world"])[0] == np.array(TOKENIZER.encode("hello <|endoftext|> world", add_special_tokens=False).ids, np.uint16).tobytes()


def test_words_of_all_code_points_agree_with_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1{c} {c}S's" for c in points[at : at + 64]) for at in range(0, len(points), 64)]
    own = wavelet.WordIds(PATH)
    some = texts[:1100] + texts[1100::20]
    for at in range(0, len(some), 256):
        part = some[at : at + 256]
        want = [e.ids for e in TOKENIZER.encode_batch(part, add_special_tokens=False)]
        assert [np.frombuffer(i, own.kind).tolist() for i in own.encode(part)] == want


def test_ids_of_many_rows_have_shards_of_their_own(spark):
    rows = [(None, "no id")] * 50 + [(7, f"word{i} more") for i in range(40)] + [(i, "one two") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, shard_rows=10)
    held = wavelet.write(docs, PATH, 2, shard_rows=10).select("shard", "doc_ids").collect()
    assert max(sum(len(r.doc_ids) for r in held if r.shard == s) for s in {r.shard for r in held}) <= 25
    assert all(set(r.doc_ids) in ({None}, {7}) for r in held if 7 in r.doc_ids and len(r.doc_ids) > 1 or None in r.doc_ids)


def test_lookups_from_files(spark, documents, tmp_path):
    path = str(tmp_path / "ids")
    segments = wavelet.write(documents, PATH, 2, shard_rows=40, segment_ids=3000, path=path)
    assert len(list((tmp_path / "ids").glob("shard=*/*.parquet"))) == segments.select("shard").distinct().count() > 3
    every = []
    for r in sorted(documents.select("doc_id", "text").collect()):
        every += [(r.doc_id, i, t) for i, t in enumerate([*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2])]
    for token in (2, 269, 49407):
        want = [(d, i, p) for p, (d, i, t) in enumerate(every) if t == token]
        assert sorted(map(tuple, wavelet.lookup(segments, token).collect())) == sorted(want)
        assert sum(r.n for r in wavelet.count(segments, token).collect()) == len(want)
    asked = [0, 5, len(every) - 1, len(every), len(every) // 2, 5]
    got = wavelet.access(wavelet.read(spark, path), asked)
    assert sorted(map(tuple, got.collect())) == sorted((p, every[p][2]) for p in set(asked) if p < len(every))


def test_select_of_rare_ids_opens_what_it_steps_into():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 40, 60_000).astype(np.uint16)
    ids[[5, 5_000, 59_999]] = 49_000
    ids[30_000:30_400] = 41
    matrix = wavelet.WaveletMatrix.unpacked(len(ids), *wavelet.WaveletMatrix.of(ids, 16).packed())
    assert matrix.count(9_000) == 0 and len(matrix.planes.open) <= 6  # the range is empty before the last planes
    assert matrix.places(49_000).tolist() == [5, 5_000, 59_999] and matrix.select(49_000, 3) == -1
    assert matrix.places(41).tolist() == list(range(30_000, 30_400))
    for value in (0, 17, 39, 41):
        places = np.flatnonzero(ids == value)
        assert [matrix.select(value, n) for n in (0, 1, len(places) // 2, len(places) - 1)] == places[[0, 1, len(places) // 2, -1]].tolist()


def test_rare_tokens_open_their_shards_only(spark, tmp_path):
    path, rng = str(tmp_path / "ids"), np.random.default_rng(5)
    rows = [(i, "the cat sat on the mat " * 3000 + "zyzzyva " * (i == 77) + " ".join(f"w{n}" for n in rng.integers(0, 100_000, 3000))) for i in range(60, 120)]
    segments = wavelet.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, 2, shard_rows=4, path=path)
    ids = TOKENIZER.encode("zyzzyva", add_special_tokens=False).ids
    others = set(TOKENIZER.encode(" ".join(t for _, t in rows).replace("zyzzyva ", ""), add_special_tokens=False).ids)
    token = next(t for t in ids if t not in others)
    (only,) = wavelet.shards_with(segments, token)
    assert [r.doc_id for r in wavelet.lookup(segments, token).collect()] == [77]
    size, read = 0, 0
    for f in (tmp_path / "ids").glob("shard=*/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        own = {}
        for i in range(group.num_columns):
            column = group.column(i)
            own[column.path_in_schema.split(".")[0]] = own.get(column.path_in_schema.split(".")[0], 0) + column.total_compressed_size
        size += sum(own.values())
        read += sum(own.values()) if int(f.parent.name.split("=")[1]) == only else own["held"]
    assert read <= size / 5  # one of fifteen shards, and of the others what they hold, a twentieth of so small ones
    assert wavelet.shards_with(segments, 49_407) == [] and wavelet.lookup(segments, 49_407).count() == 0 and wavelet.count(segments, 49_407).count() == 0


def test_texts_of_plain_letters_are_looked_up_in_lower_case():
    texts = ["The THE the It'll 'S'LL x'sy don't... À la ÉTÉ été!! ÿØ×÷ß 12a3 $$$ _ `\\ a\tb\x0bc\x0cd\re\nf", "", "\n", "'", "The\x1cthe \x85the The", "Ångström·the STRASSE ﬁ The"]
    own = wavelet.WordIds(PATH)
    assert [np.frombuffer(i, own.kind).tolist() for i in own.encode(texts)] == [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    own = wavelet.WordIds(PATH)
    own.encode(["The THE the tHe"])
    assert len(own.words) == 1  # four before: each was learned and kept for itself
