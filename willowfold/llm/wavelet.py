"""Token ids in wavelet matrices: one compressed file for each shard, with rank and select.

Documents are encoded by a tokenizer file and cut into shards of ascending doc_id; each shard is a folder with one
file of segments.  A segment holds a wavelet matrix of its ids: for each bit of an id, highest first, a plane of
bits, with the ids whose bit is 0 before those whose bit is 1 for the next plane.  Ones are counted in steps of
512 bits and stored with the planes, each of which is compressed alone, so access to a position, the count of an id
before a position and the place of its n-th occurrence take one step a plane, without the ids themselves.
A segment also keeps which ids it has, a bitmap: ``lookup`` and ``count`` open the shards with the token only, ``access`` those asked for, planes are
opened when they are stepped into, and rare ids are found by select.

Shards hold about ``shard_rows`` documents; their bounds are quantiles of a sample of ids, which decides the shards'
sizes alone.  An id with more documents than that (rows without an id, say) has shards of its own, among which its
rows are dealt out by number.

Cached pieces: white space between words is a certain cut for such a tokenizer, so the ids of a word are
asked from the tokenizers library once and kept; the kept table is bounded.  A text that may hold one of the file's
added tokens goes to the library whole, which makes it that token.

Defined results: null counts as empty and has only the end id; a null doc_id sorts before all others;
repeated doc_ids each keep a place, next to each other; an empty table gives no rows and no file; columns other than
id and text are not read.
"""

from __future__ import annotations

import gc
import itertools
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from willowfold.llm.shared import hinted, numbered, small_batches, stash
from willowfold.sources.shared_dir import new_dir

KEPT_WORDS, KEPT_PIECES = 1_300_000, 700_000
STEP = 512
#: An id that is rarer than one of so many is looked up by select, plane by plane.
FEW = 4096
SHARD_ROWS = 4096
MOST_SHARDS = 1 << 16
SHARD_SAMPLE = 64
SEGMENT_IDS = 1 << 19
_LOWEST = -(1 << 63)


class Packed:
    """Compressed arrays, each opened when it is first asked for."""

    def __init__(self, arrays: list[bytes], kind: type):
        self.arrays, self.kind, self.open = arrays, kind, {}

    def __len__(self) -> int:
        return len(self.arrays)

    def __getitem__(self, i: int) -> np.ndarray:
        if i not in self.open:
            self.open[i] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.arrays[i]), self.kind)
        return self.open[i]


class WaveletMatrix:
    """Ids as bit planes."""

    def __init__(self, n: int, planes: list[np.ndarray] | Packed, zeros: list[int], ones: list[np.ndarray] | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ones = ones

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for shift in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << shift)) != 0
            planes.append(np.packbits(one, bitorder="little"))
            low = ids.take(np.flatnonzero(~one))
            zeros.append(len(low))
            ids = np.concatenate((low, ids.take(np.flatnonzero(one))))
        return cls(len(ids), planes, zeros)

    @property
    def ones(self) -> list[np.ndarray]:
        """Ones before each step of each plane."""
        if self._ones is None:
            self._ones = []
            for plane in self.planes:
                counts = np.bitwise_count(np.pad(plane, (0, -len(plane) % (STEP // 8)))).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64)
                self._ones.append(np.concatenate(([0], np.cumsum(counts))).astype(np.uint32))
        return self._ones

    def _rank1(self, level: int, at: int) -> int:
        """Ones of a plane before a position."""
        step = at // STEP
        part = self.planes[level][step * STEP // 8 : at // 8]
        rest = int(self.planes[level][at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(self.ones[level][step]) + int(np.bitwise_count(part).sum()) + rest.bit_count()

    def access(self, at: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][at // 8]) >> at % 8 & 1
            ones = self._rank1(level, at)
            value, at = value << 1 | bit, zeros + ones if bit else at - ones
        return value

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            if start >= stop:
                break
            a, b = self._rank1(level, start), self._rank1(level, stop)
            if value >> (len(self.zeros) - 1 - level) & 1:
                start, stop = zeros + a, zeros + b
            else:
                start, stop = start - a, stop - b
        return start, stop

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs in [start, stop)."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def select(self, value: int, nth: int) -> int:
        """The position of the nth occurrence (from 0) of an id; -1 if there are fewer."""
        if value >> len(self.zeros):
            return -1
        start, stop = self._range(value, 0, self.n)
        if start + nth >= stop:
            return -1
        return self._up(value, start + nth)

    def _up(self, value: int, at: int) -> int:
        """The position among all ids of what stands behind the last plane at a position of this id."""
        for level in range(len(self.zeros) - 1, -1, -1):
            one = value >> (len(self.zeros) - 1 - level) & 1
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def _select(self, level: int, bit: int, rank: int) -> int:
        """The position of a plane's bit with so many equal ones before it: the step by the stored counts, then the place in it."""
        ones = self.ones[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * STEP - ones
        step = int(np.searchsorted(before, rank, "right")) - 1
        part = np.unpackbits(self.planes[level][step * STEP // 8 : (step + 1) * STEP // 8], bitorder="little")
        return step * STEP + int(np.flatnonzero(part == bit)[rank - int(before[step])])

    def places(self, value: int) -> np.ndarray:
        """The positions of all occurrences of an id, ascending."""
        if value >> len(self.zeros):
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(value, 0, self.n))
        if len(at) * FEW < self.n:  # a rare id: a select a plane, and nothing is unpacked
            return np.array([self._up(value, i) for i in at.tolist()], np.int64)
        for level in range(len(self.zeros) - 1, -1, -1):
            if not len(at):
                break
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            is_one = value >> (len(self.zeros) - 1 - level) & 1
            at = np.flatnonzero(one)[at - self.zeros[level]] if is_one else np.flatnonzero(~one)[at]
        return at

    def ids(self, kind: type = np.uint32) -> np.ndarray:
        """All ids, from the last plane back to the first."""
        values, top = np.zeros(self.n, kind), len(self.planes) - 1
        for level in range(top, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            values[self.zeros[level] :] |= kind(1 << (top - level))
            order = np.empty_like(values)
            order[np.flatnonzero(~one)] = values[: self.zeros[level]]
            order[np.flatnonzero(one)] = values[self.zeros[level] :]
            values = order
        return values

    def packed(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """(zeros, planes, ones): what a file keeps of each plane."""
        pack = zstandard.ZstdCompressor(level=1)
        return self.zeros, [pack.compress(p.tobytes()) for p in self.planes], [o.tobytes() for o in self.ones]

    @classmethod
    def unpacked(cls, n: int, zeros: list[int], planes: list[bytes], ones: list[bytes]) -> WaveletMatrix:
        return cls(n, Packed(planes, np.uint8), zeros, [np.frombuffer(o, np.uint32) for o in ones])


class WordIds:
    """Ids of whole texts by a tokenizer file that drops white space, each word looked at once.

    A word of ASCII characters and Latin letters is cut further into the pieces of the file's pattern, which words with
    other capitals or punctuation share; the library's model is asked for new pieces, and the library for all other words as they are.
    Texts of such characters alone are put in lower case first, as the file has it, so that they have fewer different words.
    A full table is emptied; words are then found again from the pieces.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: Added tokens, lower-cased as the file's texts are, and of each some characters that lower case keeps, or none.
        self.added = [_normal(token) for token in added if token]
        self.marks = sorted({(_MARK.search(token) or [""])[0] for token in self.added})
        self.bits = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for at in range(0, len(texts), 8192):
            part = texts[at : at + 8192]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            yield from zip(part, (array(self.code, e.ids).tobytes() for e in found), strict=True)

    def _piece(self, piece: str) -> bytes:
        """The ids of a piece by the library's model, as bytes in the file's letters for them; kept."""
        ids = array(self.code, [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(_BYTES))]).tobytes()
        self.pieces[piece] = ids
        return ids

    def _learn(self, new: set[str]) -> None:
        words, other = self.words, []
        if len(self.pieces) > KEPT_PIECES:
            self.pieces.clear()
        known, ask = self.pieces.get, self._piece
        for word in new:
            core = word.rstrip(_MARKS)
            if core.isalpha() and core.islower() and (core.isascii() or _LOWER(core)):  # a piece, and one of marks behind it
                ids = known(core) or ask(core)
                if len(core) < len(word):
                    tail = word[len(core) :]
                    ids += known(tail) or ask(tail)
                words[word] = ids
            elif _PLAIN(word):
                words[word] = b"".join([known(p) or ask(p) for p in _PIECE.findall(word.lower())])
            else:
                other.append(word)
        words.update(self._ask(other))

    def may_hold_added(self, text: str) -> bool:
        if not any(mark in text for mark in self.marks):
            return False
        text = _normal(text)
        return any(token in text for token in self.added)

    def encode(self, texts: list[str], end: bytes = b"") -> list[bytes]:
        """The ids of each text, with those of ``end`` behind them."""
        whole = {i: t for i, t in enumerate(texts) if self.may_hold_added(t)}
        if whole:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole], end))
            own = {i: array(self.code, self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() + end for i, t in whole.items()}
            return [own[i] if i in own else next(rest) for i in range(len(texts))]
        cut = [t.lower().split() if _PLAIN_TEXT(t) else _SPACE.split(t) if any(c in t for c in _ODD) else t.split() for t in texts]
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        known = self.words
        self._learn(set().union(*cut).difference(known))
        get = known.__getitem__
        return [b"".join((*map(get, words), end)) for words in cut]


#: str.split() takes these for white space, the tokenizer does not; texts with them are cut at blanks and line feeds only.
_ODD = "\x1c\x1d\x1e\x1f"
_SPACE = re.compile("[ \n]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
_PLAIN_TEXT = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*").fullmatch
_LOWER = re.compile("[a-zß-öø-ÿ]+").fullmatch
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: The file's letters for the bytes of letters beyond ASCII, all of which start with 0xC3; bytes that are no visible Latin-1 character have a letter from 256 on.
_BYTES = {c: "Ã" + chr(b if b > 0xA0 and b != 0xAD else 256 + 33 + b - 0x7F if b < 0xA1 else 323) for c in range(0xC0, 0x100) for b in (c - 0x40,)}
# Fixed value: the file's own pattern, for lower-case words of those characters.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


_MARK = re.compile("[!-@\\[-`{-~]+")  # ASCII less letters


def _normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that its words serve all tasks."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, layout: Layout) -> Iterator[pa.RecordBatch]:
    own = word_ids(path)
    end = np.array([end_id], own.kind).tobytes()
    for batch in batches:
        gc.disable()  # a batch makes no cycles, but lists enough to have the collector walk through the tables again and again
        ids = pa.array(own.encode([t or "" for t in batch.column(1).to_pylist()], end), pa.binary())
        gc.enable()
        docs, number = batch.column(0).fill_null(_LOWEST).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(layout.shard_of(docs, number), pa.int32()), batch.column(0), ids], ["shard", "doc_id", "ids"])


_SEGMENT_NAMES = ["segment", "doc_ids", "counts", "n_ids", "zeros", "planes", "ones", "held", "shard"]
SEGMENT = "segment int, doc_ids array<long>, counts array<long>, n_ids long, zeros array<int>, planes array<binary>, ones array<binary>, held binary, shard int"


def _segment(shard: int, number: int, docs: list, ids: list[bytes], own: WordIds) -> pa.RecordBatch:
    flat = np.frombuffer(b"".join(ids), own.kind)
    counts = np.array([len(i) // own.kind().itemsize for i in ids], np.int64)
    there = np.zeros(1 << own.bits, bool)
    there[flat] = True
    held = zstandard.ZstdCompressor(level=1).compress(np.packbits(there, bitorder="little").tobytes())  # which ids the segment has
    columns = [[number], [docs], [counts], [len(flat)], *([x] for x in WaveletMatrix.of(flat, own.bits).packed()), [held], [shard]]
    longs, binaries = pa.list_(pa.int64()), pa.list_(pa.binary())
    types = [pa.int32(), longs, longs, pa.int64(), pa.list_(pa.int32()), binaries, binaries, pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], _SEGMENT_NAMES)


def _segments(batches: Iterator[pa.RecordBatch], path: str, most: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard and doc_id."""
    own = word_ids(path)
    rows = ((s, d, i) for b in batches for s, d, i in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for shard, group in itertools.groupby(rows, key=lambda r: r[0]):
        docs, ids, held, number = [], [], 0, 0
        for _, doc, data in group:
            docs.append(doc)
            ids.append(data)
            held += len(data)
            if held >= most * own.kind().itemsize:
                yield _segment(shard, number, docs, ids, own)
                docs, ids, held, number = [], [], 0, number + 1
        if docs:
            yield _segment(shard, number, docs, ids, own)


class Layout:
    """Which shard a document goes to: a range of ids, or for an id of many rows a range of their numbers."""

    def __init__(self, cuts: list[int], many: dict[int, int], shard_rows: int):
        """cuts: last ids of shards.  many: ids with more than shard_rows rows, and how many."""
        ends = sorted({*cuts, *many, *(i - 1 for i in many if i > _LOWEST)})
        self.ends, self.rows = np.array(ends, np.int64), shard_rows
        more = np.zeros(len(ends) + 1, np.int64)
        for i, n in many.items():
            more[ends.index(i)] = -(-n // shard_rows) - 1
        self.first = np.arange(len(ends) + 1) + np.cumsum(more) - more
        self.shards = int(self.first[-1]) + 1

    def shard_of(self, docs: np.ndarray, number: np.ndarray) -> np.ndarray:
        return self.first[np.searchsorted(self.ends, docs, "left")] + number // self.rows


def _own_id() -> Column:
    return F.coalesce("doc_id", F.lit(_LOWEST))


def layout_of(docs: DataFrame, shard_rows: int) -> tuple[Layout, DataFrame]:
    """The layout for docs (doc_id, ...), and the ids of many rows (own_id).

    SHARD_SAMPLE ids a shard, those with the least hash, at most SHARD_SAMPLE * MOST_SHARDS, reach the driver and every id of many rows, at most
    a shard's share of them.
    """
    counts = stash(docs.groupBy(_own_id().alias("own_id")).agg(F.count(F.lit(1)).alias("n")), "id-counts")
    total, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shard_rows = max(shard_rows, -(-rows // MOST_SHARDS))
    shards = max(1, -(-rows // shard_rows))
    many = counts.where(F.col("n") > shard_rows)
    share = min(1.0, SHARD_SAMPLE * shards / max(1, total))
    few = counts.where((F.col("n") <= shard_rows) & (F.xxhash64("own_id") <= int(_LOWEST + share * ((1 << 64) - 1025)))).orderBy("own_id").toArrow()
    ids, upto = few.column("own_id").to_numpy(), np.cumsum(few.column("n").to_numpy())
    alone = shards - sum(-(-r["n"] // shard_rows) for r in many.collect())
    cuts = ids[np.searchsorted(upto, upto[-1] * np.arange(1, alone) / alone)].tolist() if len(ids) and alone > 1 else []
    return Layout(cuts, {r["own_id"]: r["n"] for r in many.collect()}, shard_rows), many.select("own_id")


def write(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, segment_ids: int = SEGMENT_IDS, path: str | None = None) -> DataFrame:
    """Encode docs, write a file of segments for each shard to ``path``, by default a new shared folder, and return them as read back."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_dir(spark, "wavelet")
    placed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    layout, many = layout_of(placed, shard_rows)
    n = many.count()
    rows = placed.withColumn("number", F.lit(0).cast("long"))
    if n:  # rows of these ids are written with numbers of their own
        owned = placed.withColumn("own_id", _own_id())
        several = numbered(owned.join(hinted(many, n), "own_id").sortWithinPartitions("own_id"), ["own_id"], "number", "many-rows")
        rows = owned.join(hinted(many, n), "own_id", "left_anti").select("doc_id", "text", F.lit(0).cast("long").alias("number")).unionByName(several.select("doc_id", "text", "number"))
    ids = rows.mapInArrow(lambda it: _encode(it, tokenizer, end_id, layout), "shard int, doc_id long, ids binary")
    ids = ids.repartitionById(layout.shards, "shard").sortWithinPartitions("shard", "doc_id")
    ids.mapInArrow(lambda it: _segments(it, tokenizer, segment_ids), SEGMENT).write.option("compression", "none").partitionBy("shard").parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The segments of all shards below path."""
    return spark.read.schema(SEGMENT).parquet(path)


def bases(segments: DataFrame) -> DataFrame:
    """(shard, segment, n_ids, base): how many ids lie before each segment."""
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard, at most MOST_SHARDS
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    within = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("shard", "segment", "n_ids", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("segment_start"))
    return starts.join(shards, "shard").select("shard", "segment", "n_ids", (F.col("shard_start") + F.col("segment_start")).alias("base"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, WaveletMatrix]]:
    """One segment at a time."""
    for batch in batches:
        for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            yield row, WaveletMatrix.unpacked(row["n_ids"], row["zeros"], row["planes"], row["ones"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, matrix in _matrices(batches):
        ids = matrix.ids(np.uint16 if len(matrix.planes) <= 16 else np.uint32).astype("<u4")
        stops = np.cumsum(row["counts"])
        starts = stops - row["counts"]
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        n = len(crc)
        columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the segments' bit planes."""
    found = segments.mapInArrow(_digests, "shard int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = bases(segments).select("shard", "segment", "base")
    return found.join(starts, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _has(held: bytes, token: int) -> bool:
    bits = zstandard.ZstdDecompressor().decompress(held)
    return token >> 3 < len(bits) and bool(bits[token >> 3] >> (token & 7) & 1)


def shards_with(segments: DataFrame, token: int) -> list[int]:
    """The shards that have a token, by the column of what segments hold, a hundredth of the files; at most MOST_SHARDS numbers."""

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["shard"]).filter(pa.array([_has(h, token) for h in batch.column(1).to_pylist()], pa.bool_()))

    return sorted(r["shard"] for r in segments.select("shard", "held").mapInArrow(having, "shard int").distinct().collect())


def _opened(segments: DataFrame, token: int) -> DataFrame:
    """The segments of the shards that have a token; no other files are opened."""
    shards = shards_with(segments, token)
    return segments.where(F.col("shard").isin(shards)) if shards else segments.limit(0)


def count(segments: DataFrame, token: int) -> DataFrame:
    """(shard, segment, n): how often a token occurs in each segment of the shards that have it, by two ranks a plane."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([row["segment"]], pa.int32()), pa.array([matrix.count(token)], pa.int64())], ["shard", "segment", "n"])

    return _opened(segments, token).withColumns({"doc_ids": F.lit(None).cast("array<long>"), "counts": F.lit(None).cast("array<long>")}).mapInArrow(counted, "shard int, segment int, n long")


def lookup(segments: DataFrame, token: int) -> DataFrame:
    """(doc_id, at, position) of every occurrence of a token: its place in the document and among all ids."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _matrices(batches):
            places = matrix.places(token) if _has(row["held"], token) else np.zeros(0, np.int64)
            stops = np.cumsum(row["counts"])
            doc = np.searchsorted(stops, places, "right")
            at = places - (stops - row["counts"])[doc]
            n = len(places)
            columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["segment"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()).take(pa.array(doc)), pa.array(at, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "segment", "doc_id", "at", "place"])

    rows = _opened(segments, token).mapInArrow(found, "shard int, segment int, doc_id long, at long, place long")
    return rows.join(bases(segments).select("shard", "segment", "base"), ["shard", "segment"]).select("doc_id", "at", (F.col("base") + F.col("place")).alias("position"))


def access(segments: DataFrame, positions: list[int]) -> DataFrame:
    """(position, token) of the asked positions among all ids; those beyond the end have no row.  Only the shards that hold them are opened."""
    spark = segments.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(p),) for p in set(positions)], "position long"))
    starts = bases(segments)
    held = starts.join(asked, (asked.position >= starts.base) & (asked.position < starts.base + starts.n_ids))
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r in held.collect():  # one row for each asked position
        wanted.setdefault((r["shard"], r["segment"]), []).append((r["position"], r["position"] - r["base"]))

    def read_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, matrix in _matrices(batches):
            pairs = [(p, matrix.access(at)) for p, at in wanted.get((row["shard"], row["segment"]), ())]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int64()), pa.array([t for _, t in pairs], pa.int32())], ["position", "token"])

    pairs = F.broadcast(spark.createDataFrame(sorted(wanted) or [(-1, -1)], "shard int, segment int"))  # one for each asked position at most
    some = segments.where(F.col("shard").isin(sorted({s for s, _ in wanted}) or [-1])).join(pairs, ["shard", "segment"], "left_semi").select(*_SEGMENT_NAMES)
    return some.mapInArrow(read_out, "position long, token int")
