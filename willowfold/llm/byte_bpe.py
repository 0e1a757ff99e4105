"""Byte-level BPE encoding by prefix dynamic programming, and decoding.

For every byte prefix of a piece exactly one token can come last in the prefix's encoding: a token that
ends there, encodes to itself, and whose pair with the last token of the prefix before it encodes to
that very pair.  The table of these last tokens is all that encoding needs: an appended byte adds one entry
and changes none, and an edit leaves the entries before it as they are.  Walking back from the end gives
the ids.

Texts are cut by the pattern of the rank files first.  Cuts before `` ?\\S`` are certain, so chunks between
them are encoded once and kept; the kept tables are bounded and emptied when full, which
changes no result.

Defined results: null counts as empty, and an empty text has no ids; ids decode to the text's UTF-8 bytes
exactly, whatever the text; there are no special tokens; repeated rows give repeated results; columns
other than id and text are not read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from willowfold.llm.shared import small_batches

#: White space as in Unicode's White_Space property.
WHITE = "\t-\r \x85\xa0  -     　"
# The rank files' pattern, in two steps; its \s is Unicode's property, to which Python's two modules add control characters.
_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+")
# Code points that are letters or numbers in the Unicode version of Python's module and unassigned in the library's.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a "
    "11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 "
    "18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 "
    "1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
)
_RANGES = "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in NEWER.split())
_NEWER = re.compile(f"[{_RANGES}]")
_PIECE_WITH_NEWER = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![{_RANGES}])\p{{L}})+| ?(?:(?![{_RANGES}])\p{{N}})+| ?(?:[^ \p{{L}}\p{{N}}]|[{_RANGES}])+")
KEPT_CHUNKS = 600_000
KEPT_PAIRS = 1_000_000
LONG_PIECE = 64


def pieces_of(chunk: str) -> list[str]:
    """The matches of the pattern in a chunk."""
    if chunk.isspace():
        return [chunk]
    return (_PIECE if chunk.isascii() or not _NEWER.search(chunk) else _PIECE_WITH_NEWER).findall(chunk)


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of every token of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PrefixTable:
    """The last token of every prefix of one piece of bytes; grows by append, edits near a place."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", array("i", [-1])
        self.append(data)

    def append(self, data: bytes) -> None:
        start, self.data = len(self.data), self.data + data
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self.codec.last_token(self.data, end, lambda n: self.last[n]))

    def edit(self, start: int, stop: int, data: bytes) -> None:
        """Replace [start, stop): the entries up to start stay, the others are made anew."""
        tail = self.data[stop:]
        self.data = self.data[:start]
        del self.last[start + 1 :]
        self.append(data + tail)

    def ids(self) -> list[int]:
        found, end = [], len(self.data)
        while end:
            found.append(self.last[end])
            end -= len(self.codec.tokens[found[-1]])
        return found[::-1]


class _Table:
    """A hash table in arrays, so that many keys are put or looked up at once; values are 0 or more."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        bits = (2 * most).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are distinct and not in the table; one too many for its size empties it first."""
        if self.held + len(keys) > self.most:
            self.keys[:], self.values[:], self.held = -1, -1, 0
        self.held += len(keys)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]  # of several for one slot the last is in
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those not in the table."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        found = np.where(seen == keys, self.values[slot], np.int32(-1))
        rows = np.flatnonzero((seen != keys) & (seen >= 0))
        slot = slot[rows]
        while len(rows):
            slot = (slot + 1) & self.mask
            seen, sought = self.keys[slot], keys[rows]
            hit = seen == sought
            found[rows[hit]] = self.values[slot[hit]]
            on = ~hit & (seen >= 0)
            rows, slot = rows[on], slot[on]
        return found


class _Endings:
    """The endings of all tokens as a trie read backwards; many walkers step through it at once."""

    def __init__(self, endings: dict[bytes, int]):
        node = {e: n for n, e in enumerate([b"", *endings])}
        self.token = np.array([-1, *endings.values()], np.int32)
        self.table = _Table(len(endings))
        self.table.put(np.array([(node[e[1:]] << 8) | e[0] for e in endings], np.int64), np.arange(1, len(node)))

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node one byte further to the left, -1 if no token ends so."""
        return self.table.get((node.astype(np.int64) << 8) | byte)


class Codec:
    """Ids of texts and texts of ids, by the ranks of one file."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        #: Every ending of a token, with its own id if it is a token too, else -1.
        self.endings = {t[i:]: ranks.get(t[i:], -1) for t in ranks for i in range(len(t))}
        self.pair_table = _Table(KEPT_PAIRS)
        self.follows = lru_cache(maxsize=100_000)(self._follows)
        self.chunks: dict[str, bytes] = {}
        self.trie = _Endings(self.endings)
        self.sizes = np.zeros(max(self.tokens) + 2, np.int64)
        self.sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]

    def merged(self, data: bytes) -> list[int]:
        """The encoding by its definition, lowest rank first; for the few bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        """Whether right may come next after left (-1: the start)."""
        pair = [right] if left < 0 else [left, right]
        return self.merged(b"".join(self.tokens[t] for t in pair)) == pair

    def last_token(self, data: bytes, end: int, last) -> int:
        """The one token that can end data[:end]; last(n) is that of data[:n], -1 for n = 0."""
        fits, ending, start = [], self.endings.get, end - 1
        while start >= 0 and (token := ending(data[start:end])) is not None:
            if token >= 0:
                fits.append((token, start))
            start -= 1
        for token, start in reversed(fits):
            if self.follows(last(start), token):
                return token
        raise ValueError("the ranks don't cover every byte")

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """follows for many pairs."""
        keys = (left.astype(np.int64) + 1 << 32) | right
        known = self.pair_table.get(keys)
        unknown = known < 0
        if unknown.any():
            pairs, where = np.unique(keys[unknown], return_inverse=True)
            good = np.array([self._follows((p >> 32) - 1, p & 0xFFFFFFFF) for p in pairs.tolist()], np.int32)
            self.pair_table.put(pairs, good)
            known[unknown] = good[where]
        return known > 0

    def prefix_tables(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The last token of every prefix of many pieces, longest piece first: a row for each piece."""
        sizes = np.array([len(p) for p in pieces])
        longest = int(sizes[0])
        data = np.frombuffer(b"".join(p.ljust(longest, b"\0") for p in pieces), np.uint8).reshape(-1, longest)
        last = np.full((len(pieces), longest + 1), -1, np.int64)
        for end in range(1, longest + 1):
            rows = np.arange(np.searchsorted(-sizes, -end, "right"))
            node, open_, fits = np.zeros(len(rows), np.int64), np.ones(len(rows), bool), []
            for start in range(end - 1, -1, -1):
                node = self.trie.step(node, data[rows, start])
                rows, node = rows[node >= 0], node[node >= 0]
                if not len(rows):
                    break
                token = self.trie.token[node]
                fits.append((start, rows[token >= 0], token[token >= 0]))
            for start, at, token in reversed(fits):
                at, token = at[open_[at]], token[open_[at]]
                good = self.follow(last[at, start], token)
                last[at[good], end] = token[good]
                open_[at[good]] = False
        return sizes, last

    def walked_back(self, sizes: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """The ids of each piece, from its last prefix back to its start."""
        end, steps, rows = sizes.copy(), [], np.arange(len(sizes))
        while end.any():
            token = np.where(end > 0, last[rows, end], -1)
            steps.append(token)
            end -= np.where(end > 0, self.sizes[token], 0)
        found = np.stack(steps[::-1], axis=1)
        return [row[row >= 0] for row in found]

    def encode_pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids, as bytes, of distinct matches of the pattern."""
        found = {p: np.array([self.ranks[p]], "<u4").tobytes() for p in pieces if p in self.ranks}
        found |= {p: np.array(PrefixTable(self, p).ids(), "<u4").tobytes() for p in pieces if p not in found and len(p) > LONG_PIECE}
        rest = sorted((p for p in pieces if p not in found), key=len, reverse=True)
        if rest:
            ids = self.walked_back(*self.prefix_tables(rest))
            found |= {p: i.astype("<u4").tobytes() for p, i in zip(rest, ids, strict=True)}
        return found

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [_CHUNK.findall(t) for t in texts]
        known = self.chunks
        new = set().union(*cut).difference(known)
        if len(known) + len(new) > KEPT_CHUNKS:
            wanted = set().union(*cut)
            known = self.chunks = {c: i for c, i in known.items() if c in wanted}
        pieces = {c: [p.encode() for p in pieces_of(c)] for c in new}
        ids = self.encode_pieces(list({p for own in pieces.values() for p in own}))
        known.update((c, b"".join([ids[p] for p in own])) for c, own in pieces.items())
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def chunk(self, chunk: str) -> bytes:
        return self.encode_texts([chunk])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_texts([text])[0], "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class TextTable:
    """An encoded text that takes appends and edits, encoding anew only from the last certain cut before them."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.parts = codec, [(c, codec.chunk(c)) for c in _CHUNK.findall(text)]

    def append(self, text: str) -> None:
        tail = "".join(c for c, _ in self.parts[-2:])
        self.parts[-2:] = [(c, self.codec.chunk(c)) for c in _CHUNK.findall(tail + text)]

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replace characters [start, stop); chunks well before and after keep their ids."""
        at, first, last = 0, None, len(self.parts)
        for n, (c, _) in enumerate(self.parts):
            if first is None and at + len(c) >= start:
                first, begin = max(0, n - 2), at - sum(len(p) for p, _ in self.parts[max(0, n - 2) : n])
            if at >= stop and not c[0].isspace() or at > stop and c[0] == " " and len(c) > 1 and not c[1].isspace():
                last = n
                break
            at += len(c)
        if first is None:
            return self.append(text)
        # a chunk that follows begins at a certain cut only behind another chunk's end, so one more is taken in
        last = min(last + 1, len(self.parts))
        old = "".join(c for c, _ in self.parts[first:last])
        new = old[: start - begin] + text + old[stop - begin :]
        self.parts[first:last] = [(c, self.codec.chunk(c)) for c in _CHUNK.findall(new)]
        return None

    def ids(self) -> list[int]:
        return np.frombuffer(b"".join(i for _, i in self.parts), "<u4").tolist()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker, so that its tables serve all tasks."""
    return Codec(read_ranks(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        ids = pa.array(own.encode_texts([t or "" for t in batch.column(1).to_pylist()]), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        data = pa.array([own.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], ["doc_id", "ids", "bytes"])


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) with ids as little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda it: _encode(it, ranks_path), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, bytes) from what encode gives."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, ranks_path), f"doc_id {kind}, ids binary, bytes binary")
