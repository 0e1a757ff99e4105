"""Near-duplicate vectors of equal label by an inverted multi-index.

Vectors are cut in halves, each half has a codebook, and the product of the two is a grid of cells.  Every vector lies
in the cell of its nearest codewords.  In each half, a vector is at least as far from all that lies with a codeword as
from the plane between that codeword and its own nearest one; the squares of the two halves' bounds add up to a
bound for the cell.  A vector visits cells in the order of the multi-sequence algorithm, by the sum of those bounds,
until the bound passes the radius.

The radius sets the recall.  For recall 1 it is the distance of unit vectors at the threshold: no link can lie beyond
it, so all are found.  For less it is the bound that the target part of partners drawn at the very threshold, the
hardest case, do not pass.  Vectors met in a cell are verified by their cosine in double precision, so no pair
below the threshold is linked.

Identical vectors are folded into one class first, with a number of its own.  Of two vectors the one with the lower
home cell visits the other, so a pair is met once.  A cell does not emit its pairs but the sums of links it found for
each vector, and links enough to keep its vectors connected, so its output is no larger than its input.  A cell with
more members or visitors than CELL_ROWS is dealt out as pairs of blocks.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, have no label or no id
link with nothing (0 links, their own component); vectors of different lengths do not link; identical rows are linked
as vectors of their own; rows of one id with different vectors each have their own links; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from willowfold.llm.shared import components, hinted, stash
from willowfold.llm.simhash import merge

THRESHOLD = 0.98
TARGET_RECALL = 0.999
#: Codebooks are fitted on so many vectors at least, and so many for each codeword.
SAMPLE, SAMPLE_PER_WORD = 8192, 16
CELL_MEMBERS = 24
MOST_WORDS = 4096
CELL_ROWS = 8192
_BLOCK = 1024


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def codebook(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Up to k different k-means centres."""
    words = points[rng.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = nearest(points, words)
        words = np.array([points[own == c].mean(axis=0) if (own == c).any() else words[c] for c in range(len(words))])
    return np.unique(words, axis=0)


def squares(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ words.T + (words**2).sum(axis=1)[None, :]


def nearest(points: np.ndarray, words: np.ndarray, block: int = 4096) -> np.ndarray:
    """The nearest codeword of each point, by blocks of points, so that the table of distances stays small however many codewords there are."""
    return np.concatenate([np.argmin(squares(points[i : i + block], words), axis=1) for i in range(0, len(points), block)])


class Grid:
    """Two codebooks, and how far the cells that a vector visits may be from it."""

    def __init__(self, first: np.ndarray, second: np.ndarray, radius: float):
        self.words, self.radius = (first, second), radius
        self.apart = [np.sqrt(np.maximum(squares(w, w), 0)) for w in self.words]
        for apart in self.apart:
            np.fill_diagonal(apart, np.inf)

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, threshold: float, recall: float) -> Grid:
        rng = np.random.default_rng(2012)
        points = unit(sample)
        half = points.shape[1] // 2
        farthest = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # to spare for the rounding of squares
        grid = cls(codebook(points[:, :half], k, rng), codebook(points[:, half:], k, rng), farthest)
        if recall < 1:
            some = points[:4096]
            noise = rng.standard_normal(some.shape)
            noise -= (noise * some).sum(axis=1, keepdims=True) * some
            size = np.linalg.norm(noise, axis=1, keepdims=True)
            partners = threshold * some + np.sqrt(1 - threshold**2) * noise / np.where(size > 0, size, 1)
            lower = grid.home(some) <= grid.home(partners)
            visitor, host = np.where(lower[:, None], some, partners), np.where(lower[:, None], partners, some)
            a, b = grid.bounds(visitor)
            i, j = np.divmod(grid.home(host), len(grid.words[1]))
            rows = np.arange(len(some))
            grid.radius = min(farthest, float(np.sqrt(np.quantile(a[rows, i] + b[rows, j], recall, method="higher"))) + 1e-6)
        return grid

    def _halves(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        half = points.shape[1] // 2
        for part, words, apart in zip((points[:, :half], points[:, half:]), self.words, self.apart, strict=True):
            yield squares(part, words), words, apart

    def home(self, points: np.ndarray) -> np.ndarray:
        i, j = (np.argmin(s, axis=1) for s, _, _ in self._halves(points))
        return i * len(self.words[1]) + j

    def bounds(self, points: np.ndarray) -> list[np.ndarray]:
        """For each half, the squares of the least distances from each point to what lies with each codeword."""
        found = []
        for s, _, apart in self._halves(points):
            own = np.argmin(s, axis=1)
            found.append(((s - s[np.arange(len(s)), own][:, None]) / (2 * apart[own])) ** 2)
        return found

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit: cells within the radius after the row's home, nearest codewords first."""
        home, most = self.home(points), self.radius**2
        bounds = self.bounds(points)
        order = [np.argsort(b, axis=1, kind="stable") for b in bounds]
        a, b = (np.take_along_axis(x, o, 1) for x, o in zip(bounds, order, strict=True))
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(a.shape[1]):
            some = np.flatnonzero(a[:, r] <= most)
            if not len(some):
                break
            n = (b[some] <= most - a[some, r][:, None]).sum(axis=1)  # the staircase of the multi-sequence
            row = np.repeat(some, n)
            s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(row)
            cells.append(order[0][row, r] * len(self.words[1]) + order[1][row, s])
        row, cell = np.concatenate(rows), np.concatenate(cells)
        later = cell > home[row]
        return row[later], cell[later]


PREPARED = "vec_id long, label long, dim int, x binary"
PLACED = "label long, dim int, cell int, part long, visitor boolean, block int, class long, copies long, x binary"
_NAMES = [c.split()[0] for c in PLACED.split(", ")]


def _bytes(x: np.ndarray) -> pa.Array:
    """A binary for each row."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, len(x) * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _matrix(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(len(column), dim).astype(np.float64)


def _prepared(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Rows with the bytes of their vector, null where it can link with nothing."""
    for batch in batches:
        vec_id, label, vectors = batch.columns
        known = vec_id.is_valid().to_numpy(zero_copy_only=False) & label.is_valid().to_numpy(zero_copy_only=False)
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            good = np.zeros(len(rows), bool)
            if dim:
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1) & known[rows]
                at = pa.array(rows[good])
                yield pa.RecordBatch.from_arrays([vec_id.take(at), label.take(at), pa.array(np.full(len(at), dim, np.int32)), _bytes((x[good] + 0.0).astype(kind))], ["vec_id", "label", "dim", "x"])
            at = pa.array(rows[~good])
            yield pa.RecordBatch.from_arrays([vec_id.take(at), label.take(at), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], ["vec_id", "label", "dim", "x"])


def _placed(batches: Iterator[pa.RecordBatch], grids: dict[int, Grid], kind: str) -> Iterator[pa.RecordBatch]:
    """A member row in the home cell and a visitor row in each other cell visited."""
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.take(pa.array(np.flatnonzero(dims == dim)))
            n = own.num_rows
            row, cell = np.arange(n), np.zeros(n, np.int64)
            if dim in grids:
                points = unit(_matrix(own.column("x"), dim, kind))
                more, visited = grids[dim].visits(points)
                row, cell = np.concatenate((row, more)), np.concatenate((grids[dim].home(points), visited))
            at = pa.array(row)
            label, number, copies, x = (own.column(c).take(at) for c in ("label", "class", "copies", "x"))
            zero = np.zeros(len(row), np.int64)
            columns = [label, pa.array(zero + dim, pa.int32()), pa.array(cell, pa.int32()), pa.array(zero), pa.array(np.arange(len(row)) >= n), pa.array(zero, pa.int32()), number, copies, x]
            yield pa.RecordBatch.from_arrays(columns, _NAMES)


def _links_of(x: np.ndarray, visitor: np.ndarray, block: np.ndarray, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of one cell: links found for each row, and the forest that joins them (a, b)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((x * x).sum(axis=1))
    members, guests = np.flatnonzero(~visitor), np.flatnonzero(visitor)
    blocks = np.unique(block[members])
    links, label = np.zeros(len(x), np.int64), np.arange(len(x))

    def compare(left: np.ndarray, right: np.ndarray, alike: bool) -> None:
        for a in (left[i : i + _BLOCK] for i in range(0, len(left), _BLOCK)):
            for b in (right[i : i + _BLOCK] for i in range(0, len(right), _BLOCK)):
                if alike and b[-1] < a[0]:
                    continue
                i, j = np.nonzero(x[a] @ x[b].T >= threshold * norm[a][:, None] * norm[b][None, :])
                i, j = a[i], b[j]
                if alike:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                merge(label, i, j)

    if len(blocks) == 2:
        compare(members[block[members] == blocks[0]], members[block[members] == blocks[1]], False)
    elif len(members):
        if blocks[0] >= 0:
            compare(members, members, True)
        if len(guests):
            compare(guests, members, False)
    own = np.flatnonzero(label != np.arange(len(x)))
    return links, own, label[own]


def _linked(batches: Iterator[pa.RecordBatch], threshold: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell and part; (a, b, links): a link of the forest, or with b null the sum of a's links."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
        if not held or batch is not None and not batch.num_rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("label", "dim", "cell", "part")])
        starts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1))
        stop = len(starts) if batch is None else len(starts) - 1
        found: list[tuple[np.ndarray, ...]] = []
        for n in range(stop):
            low, high = starts[n], starts[n + 1] if n + 1 < len(starts) else table.num_rows
            if high - low == 1:
                continue
            part = table.slice(low, high - low)
            visitor, block, number, copies = (part.column(c).to_numpy(zero_copy_only=False) for c in ("visitor", "block", "class", "copies"))
            links, a, b = _links_of(_matrix(part.column("x"), int(keys[1, low]), kind), visitor, block, copies, threshold)
            some = np.flatnonzero(links)
            found.append((np.concatenate((number[a], number[some])), np.concatenate((number[b], np.full(len(some), -1))), np.concatenate((np.zeros(len(a), np.int64), links[some]))))
        if found:
            a, b, links = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b < 0), pa.array(links)], ["a", "b", "links"])
        held = [] if batch is None else [table.slice(starts[-1])]


def grids_of(found: DataFrame, threshold: float, recall: float, kind: str, sample: int = SAMPLE) -> dict[int, Grid]:
    """A grid for each length of vectors.

    Codebooks are fitted on the ``sample``, or SAMPLE_PER_WORD for each codeword, classes with the least hash: at most MOST_WORDS * SAMPLE_PER_WORD vectors.
    """
    sizes: dict[int, list[int]] = {}
    for r in found.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect():  # a row for each length
        sizes[r["dim"]] = [r["most"], r["n"]]
    grids = {}
    for dim, (most, n) in sizes.items():
        k = min(MOST_WORDS, int((most / CELL_MEMBERS) ** 0.5))
        if k > 1 and dim > 1:
            wanted = max(sample, SAMPLE_PER_WORD * k)
            share = min(1.0, 1.5 * wanted / n + 100 / n)  # almost surely enough; the exact cut follows
            h = F.xxhash64("label", "x")
            rows = found.where((F.col("dim") == dim) & (h <= int(-(1 << 63) + share * ((1 << 64) - 1025)))).select(h.alias("h"), "x").collect()
            rows = sorted((r["h"], bytes(r["x"])) for r in rows)[:wanted]
            grids[dim] = Grid.fit(np.frombuffer(b"".join(x for _, x in rows), kind).reshape(-1, dim).astype(np.float64), k, threshold, recall)
    return grids


def dealt(placed: DataFrame, cell_rows: int) -> DataFrame:
    """Cells with more than cell_rows members or visitors in parts of about twice that many rows at most.

    Members are cut into blocks and meet in every pair of blocks; visitors are cut into blocks of their own, each of which
    meets every block of members.  In a part for visitors the members' block is -1: there they do not meet each other.
    """
    cell = ["label", "dim", "cell"]
    sizes = placed.groupBy(*cell).agg(F.count_if(~F.col("visitor")).alias("m"), F.count_if(F.col("visitor")).alias("v"))
    sizes = sizes.where((F.col("m") > cell_rows) | (F.col("v") > cell_rows))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / cell_rows)).cast("int")
    hot = stash(sizes.select(*cell, blocks("m").alias("mb"), blocks("v").alias("vb")), "hot-cells")
    n = hot.count()
    if not n:
        return placed
    cut = placed.join(hinted(hot, n), cell)
    member = cut.where("not visitor").withColumn("block", F.pmod(F.xxhash64("class"), F.col("mb")).cast("int"))
    pairs = member.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    pairs = pairs.withColumn("part", F.least("block", "_o").cast("long") * F.col("mb") + F.greatest("block", "_o"))
    after = F.col("mb").cast("long") * F.col("mb")
    hosts = member.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).withColumn("part", after + F.col("block").cast("long") * F.col("vb") + F.col("_o")).withColumn("block", F.lit(-1))
    guests = cut.where("visitor").withColumn("_v", F.pmod(F.xxhash64("class"), F.col("vb"))).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
    guests = guests.withColumn("part", after + F.col("_o").cast("long") * F.col("vb") + F.col("_v"))
    found = placed.join(hinted(hot, n), cell, "left_anti").select(*_NAMES)
    for part in (pairs, hosts, guests):
        found = found.unionByName(part.select(*_NAMES))
    return found


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, recall: float = TARGET_RECALL, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; all links are found with recall 1."""
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    given = vectors.select(F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>"))
    rows = given.mapInArrow(lambda it: _prepared(it, kind), PREPARED)
    found = rows.where("x is not null").groupBy("label", "dim", "x").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    found = stash(found.withColumn("class", F.monotonically_increasing_id()), "classes")  # numbered where they are written
    grids = grids_of(found, threshold, recall, kind)
    placed = found.select("label", "dim", "class", "copies", "x").mapInArrow(lambda it: _placed(it, grids, kind), PLACED)
    keys = ["label", "dim", "cell", "part"]
    placed = dealt(placed, cell_rows).repartition(*keys).sortWithinPartitions(*keys)
    linked = stash(placed.mapInArrow(lambda it: _linked(it, threshold, kind), "a long, b long, links long"), "vector-links")
    sums = linked.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(linked.where("b is not null"), "a", "b").select(F.col("node").alias("class"), "root")
    roots = stash(roots.union(roots.select("root", "root").distinct()), "class-roots")
    least = found.select("class", "first").join(roots, "class").groupBy("root").agg(F.min("first").alias("component_id"))
    answers = sums.join(roots.join(least, "root"), "class", "full").select("class", "links", "component_id")
    digest = F.unhex(F.sha2("x", 256)).alias("digest")
    answers = found.select("class", "label", "dim", "first", "copies", digest).join(answers, "class", "left")
    answers = answers.select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component_id", "first").alias("component"))
    known = rows.select("vec_id", "label", "dim", digest).join(answers, ["label", "dim", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return known.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


#: All pairs, for small tables.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.a, r.root FROM reach r JOIN links l ON l.b = r.vec_id),
roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e LEFT JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
