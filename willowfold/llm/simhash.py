"""Near-duplicates by 64-bit SimHash fingerprints, linked through pivot distance tables.

A pivot distance table holds the Hamming distance of every fingerprint to many reference
fingerprints.  By the triangle inequality two fingerprints within ``radius`` bits differ by at most
``radius`` in every column.  Three kinds of references are used:

* ``UNIT`` references, a base and the base with one bit turned: the difference of such a column to
  the base column is +1 or -1, so these columns are the fingerprint's bits in another form, and what
  follows is a search by blocks of bits that agree.  The columns fall into blocks; a difference of up to
  four bits leaves all blocks but four alike, so every choice of the others gives cells in which all partners
  of a fingerprint lie.  There are six blocks, or more for very many fingerprints, so that the mean cell stays small.
* ``SPREAD`` references, which are far from each other: inside a cell pairs are discarded by the
  largest difference of these columns, and the survivors verified by their exact distance.
* Midpoints, for what is dense: two fingerprints within ``radius`` have a reference between them, half of
  the radius from either, and all that lie so near to one reference are within the radius of each other.

A cell with more than CELL_ROWS fingerprints is cut again by the columns outside its blocks.  A part that is
still larger emits for each of its fingerprints the midpoints in the columns that its members do not share, at
most a few hundred, and all at one midpoint are linked to the first.  So no cell compares more than CELL_ROWS
fingerprints with each other, the work of larger ones is in proportion to their members, and no pair is lost.

A task folds its links before they are written: what they join stays joined by one link for each of its fingerprints, so that
tables and midpoints that meet the same pairs again do not multiply them.
Joining links into components goes by star steps; the links of one node meet in one key, which the planner may split.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts of
fewer words than the shingle have one shingle; repeated shingles count repeatedly; equal fingerprints
(repeated rows among them) always share a component; a null doc_id keeps its row and is never a
component's id unless nothing else is in it.  Columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from willowfold.llm.shared import components, discard, hinted, keyed, small_batches, stash, without_rows

RADIUS = 4
SHINGLE = 4
SEED = 42
BITS = 64
CELL_ROWS = 4096
_CHUNK = 1 << 16

_rng = np.random.default_rng(20140601)
BASE = np.uint64(_rng.integers(0, 1 << 63, dtype=np.uint64))
SPREAD = _rng.integers(0, np.iinfo(np.uint64).max, size=24, dtype=np.uint64)
UNIT = BASE ^ (np.uint64(1) << np.arange(BITS, dtype=np.uint64))
CELL = "cell long, part long, fp long"


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one whole text, as an unsigned 64-bit number."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], stops[:-1]))
    span = min(shingle, len(words))
    starts, stops = starts[: len(words) - span + 1].tolist(), (stops[span - 1 :] - 1).tolist()
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in part), np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, fp long")


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot distance table: a row for each fingerprint, a column for each reference."""
    return np.bitwise_count(fps[:, None] ^ references[None, :]).astype(np.int8)


def _signs(fps: np.ndarray) -> np.ndarray:
    """The columns of the unit references less the base column, as 0 and 1."""
    return (distances(fps, UNIT) > distances(fps, np.array([BASE]))).astype(np.int64)


def _code(signs: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The number that some columns spell."""
    return signs[:, columns] @ (np.int64(1) << np.arange(len(columns), dtype=np.int64))


def blocks_for(fingerprints: int, cell_rows: int) -> int:
    """The least number of blocks, from six on, with which the mean cell is at most an eighth of a hot one."""
    return next((b for b in range(6, 9) if fingerprints >> BITS * (b - RADIUS) // b <= cell_rows // 8), 8)


def choices(blocks: int) -> list[np.ndarray]:
    """For every table the columns that its cells share: all blocks but four."""
    parts = np.array_split(np.arange(BITS), blocks)
    return [np.concatenate(some) for some in itertools.combinations(parts, blocks - RADIUS)]


def _cells(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """A cell is a table's number above the number that its columns spell, which has 33 bits at most."""
    for batch in batches:
        signs = _signs(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for k, columns in enumerate(choices(blocks)):
            cell = (np.int64(k) << np.int64(40)) | _code(signs, columns)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(len(cell), np.int64)), batch.column(0)], ["cell", "part", "fp"])


def _second(columns: np.ndarray) -> list[np.ndarray]:
    """For every part of a hot cell the further columns that it shares: any 4 of 8 groups of those outside the cell's blocks."""
    groups = np.array_split(np.setdiff1d(np.arange(BITS), columns), 8)
    return [np.concatenate(four) for four in itertools.combinations(groups, 4)]


def _cut_again(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        signs = _signs(fps.view(np.uint64))
        for k in np.unique(cells >> 40).tolist():
            own = np.flatnonzero(cells >> 40 == k)
            for n, columns in enumerate(_second(choices(blocks)[k])):
                part = (np.int64(n + 1) << np.int64(40)) | _code(signs[own], columns)
                yield pa.RecordBatch.from_arrays([pa.array(cells[own]), pa.array(part), pa.array(fps[own])], ["cell", "part", "fp"])


def turned(columns: np.ndarray, most: int) -> np.ndarray:
    """Masks that turn up to ``most`` of some columns' bits."""
    bits = [int(np.uint64(1) << np.uint64(c)) for c in columns]
    return np.array([sum(some) for n in range(most + 1) for some in itertools.combinations(bits, n)], np.uint64)


def _midpoints(batches: Iterator[pa.RecordBatch], blocks: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Every fingerprint of a dense part with the references that are half of the radius away, rounded down (near) or up."""
    for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
        cells, parts, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        kinds = np.stack((cells >> 40, parts >> 40))
        for k, n in np.unique(kinds, axis=1).T.tolist():
            own = np.flatnonzero((kinds[0] == k) & (kinds[1] == n))
            shared = choices(blocks)[k]
            free = np.setdiff1d(np.arange(BITS), np.concatenate((shared, _second(shared)[n - 1])))
            masks, near = turned(free, -(-radius // 2)), len(turned(free, radius // 2))
            for at in range(0, len(masks), 64):
                some = masks[at : at + 64]
                middle = (fps[own].view(np.uint64)[:, None] ^ some[None, :]).ravel().view(np.int64)
                far = np.tile(np.arange(at, at + len(some)) >= near, len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cells[own], len(some))), pa.array(np.repeat(parts[own], len(some))), pa.array(middle), pa.array(far), pa.array(np.repeat(fps[own], len(some)))], ["cell", "part", "middle", "far", "fp"])


def _at_midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by midpoint, near ones first: links of all rows of a midpoint to its first, if that is near."""
    last: tuple | None = None  # the midpoint that the batch before ended with, and the first row there
    for batch in batches:
        if not batch.num_rows:
            continue
        *keys, far, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        fresh = np.ones(len(fps), bool)
        fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        goes_on = last is not None and last[0] == tuple(int(k[0]) for k in keys)
        starts = np.flatnonzero(fresh)
        run = np.cumsum(fresh) - 1
        hub, is_near = fps[starts], ~far[starts]
        if goes_on:
            hub[0], is_near[0] = last[1:]
        linked_rows = is_near[run] & (fps != hub[run])
        last = (tuple(int(k[-1]) for k in keys), hub[-1], is_near[-1])
        yield pa.RecordBatch.from_arrays([pa.array(fps[linked_rows]), pa.array(hub[run][linked_rows])], ["a", "b"])


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a and b in label, in place; a label is the smallest member's index."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jumped := label[label]):
            label[:] = jumped


def linked(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each run of equal group, what lies within radius: at most a link a row."""
    label, columns = np.arange(len(fps)), distances(fps, SPREAD)
    left, right, held = [], [], 0
    rows, step = np.arange(len(fps)), 1
    while len(rows := rows[rows + step < len(fps)]):
        rows = rows[group[rows] == group[rows + step]]
        for at in range(0, len(rows), 1 << 18):
            a = rows[at : at + (1 << 18)]
            a = a[np.abs(columns[a] - columns[a + step]).max(axis=1) <= radius]
            a = a[np.bitwise_count(fps[a] ^ fps[a + step]) <= radius]
            left, right, held = [*left, a], [*right, a + step], held + len(a)
        if held > 1 << 20:
            merge(label, np.concatenate(left), np.concatenate(right))
            left, right, held = [], [], 0
        step += 1
    if held:
        merge(label, np.concatenate(left), np.concatenate(right))
    own = np.flatnonzero(label != np.arange(len(fps)))
    return fps[own], fps[label[own]]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; the last cell of a batch waits for the next one."""
    held: list[list[np.ndarray]] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            if sum(len(x[0]) for x in held) < _CHUNK:
                continue
        if not held:
            return
        cell, part, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        fresh = np.concatenate(([True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1])))
        cut = len(cell) if batch is None else int(np.flatnonzero(fresh)[-1])
        held = [[cell[cut:], part[cut:], fps[cut:]]] if cut < len(cell) else []
        if cut:
            a, b = linked(np.cumsum(fresh[:cut]), fps[:cut].view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def folded(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Links that join what a task's links join, at most one for each of its fingerprints; folded again whenever there are ``most``."""
    left, right, held = [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        fps, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
        label, half = np.arange(len(fps)), len(at) // 2
        merge(label, at[:half], at[half:])
        own = np.flatnonzero(label != np.arange(len(fps)))
        return fps[own], fps[label[own]]

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        left, right, held = [*left, a], [*right, b], held + len(a)
        if held >= most:
            a, b = joined()
            if len(a) >= most // 2:  # so many fingerprints: these are done with
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
            left, right, held = [a], [b], len(a)
    if held:
        a, b = joined()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id reachable by links.

    radius may be up to 4: the blocks guarantee whole results only that far.
    """
    if not 0 <= radius <= RADIUS:
        raise ValueError("radius must be 0 to 4")
    owned = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stash(owned.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = links_of(distinct.select("fp"), radius, cell_rows)
    roots = components(links, "a", "b")
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    discard(links, distinct)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return owned.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def links_of(fps: DataFrame, radius: int = RADIUS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b), written, that join all different fingerprints within radius, as far as components go."""
    blocks = blocks_for(fps.count(), cell_rows)
    cells = stash(fps.mapInArrow(lambda it: _cells(it, blocks), CELL), "cells")
    hot = stash(cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell"), "hot")
    dealt, dense, kept = cells, None, [cells, hot]
    if n := hot.count():
        parts = cells.join(hinted(hot, n), "cell", "left_semi").select("cell", "fp").mapInArrow(lambda it: _cut_again(it, blocks), CELL)
        parts = stash(parts, "parts")
        full = stash(parts.groupBy("cell", "part").count().where(F.col("count") > cell_rows).select("cell", "part"), "dense")
        kept += [parts, full]
        dealt = cells.join(hinted(hot, n), "cell", "left_anti").select("cell", "part", "fp")
        if m := full.count():
            dense = parts.join(hinted(full, m), ["cell", "part"], "left_semi").select("cell", "part", "fp")
            parts = parts.join(hinted(full, m), ["cell", "part"], "left_anti").select("cell", "part", "fp")
        dealt = dealt.union(parts)
    dealt = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "fp")
    links = dealt.mapInArrow(lambda it: folded(_links(it, radius)), "a long, b long")
    if dense is not None:
        middles = dense.mapInArrow(lambda it: _midpoints(it, blocks, radius), "cell long, part long, middle long, far boolean, fp long")
        at = ["cell", "part", "middle"]
        links = links.union(middles.repartition(*at).sortWithinPartitions(*at, "far", "fp").mapInArrow(lambda it: folded(_at_midpoints(it)), "a long, b long"))
    links = stash(links, "fp-links")
    discard(*kept)
    return links


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, the one with the smallest id (null only if none has one), all columns as they were."""
    rows, key = keyed(docs, id_col)
    found = near_duplicates(rows, key, text_col)
    return without_rows(rows, found.where("doc_id <> component_id"), key)
