"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Packing needs only how many pieces there are of each length, so Spark counts lengths, one small table of at most
``max(sizes)`` rows is packed, and the plan, as runs of equal bins, is joined back to the pieces by their rank
within their length.  Nothing else reaches the driver, and a bin number is arithmetic on the rank.  Runs are broadcast only while their counted number is small.

* A document longer than the largest size is cut into full pieces and a rest.
* Pieces go in by length, longest first, each into the open bin with the least room that takes it.
* If no open bin takes it, the size of least cost is opened: its price, less the worth of the room it leaves.  Room
  is worth the best price per unit, times ``use``, the part of it that is expected to be filled.
* In the end every bin is downsized to the smallest permitted size that holds its contents.

The length of a document is the bytes of its UTF-8 text and one end mark.

Defined results: a null or empty text has length 1, its end mark; repeated rows are packed once each; a null
doc_id is packed like any other; an empty table gives no rows; extra columns are not read by ``pack`` and
kept by none of its outputs.
"""

from __future__ import annotations

import bisect
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from willowfold.llm.shared import hinted, ranked, stash

SIZES = (2048, 4096, 8192, 16384)
#: The price of a sequence: its length, plus a fixed part for each sequence, plus attention's growth with length.
OVERHEAD, QUADRATIC = 64, 1 / 262_144
USE = 0.97


def price(size: int) -> float:
    return OVERHEAD + size + QUADRATIC * size * size


def opened(length: int, sizes: tuple[int, ...], use: float = USE) -> int:
    """The size of least cost for a piece that fits into no open bin; the smallest one on ties."""
    worth = use * min(price(s) / s for s in sizes)
    return min((s for s in sizes if s >= length), key=lambda s: (price(s) - worth * (s - length), s))


def plan(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, use: float = USE) -> list[tuple[int, ...]]:
    """Best fit of counts[length] pieces of every length, as runs of equal bins.

    A run (length, first_rank, last_rank, first_bin, each, filled, size, used) puts the pieces of ranks
    first_rank..last_rank into bins from first_bin on, ``each`` to a bin, behind ``filled`` units; those bins
    end with ``used`` units in sequences of ``size``.  Of open bins with equal room the one opened smaller is taken.
    """
    sizes = tuple(sorted(sizes))
    held: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # (room left, size opened) -> (first bin, bins)
    rooms: list[tuple[int, int]] = []  # the keys of held, ascending
    runs, bins = [], 0

    def put(left: int, size: int, first: int, n: int) -> None:
        if (left, size) not in held:
            bisect.insort(rooms, (left, size))
        held[left, size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect.bisect_left(rooms, (length, 0))
            if at < len(rooms):
                left, size = rooms[at]
                first, n = held[left, size].pop()
                if not held[left, size]:
                    del held[rooms.pop(at)]
            else:
                left = size = opened(length, sizes, use)
                first, n = bins, -(-todo // (size // length))
                bins += n
            each = left // length
            full = min(n, todo // each)
            if full:
                runs.append((length, rank, rank + full * each - 1, first, each, size - left))
                put(left - each * length, size, first, full)
                rank, todo, first, n = rank + full * each, todo - full * each, first + full, n - full
            if todo and n:
                runs.append((length, rank, rank + todo - 1, first, todo, size - left))
                put(left - todo * length, size, first, 1)
                todo, first, n = 0, first + 1, n - 1
            if n:
                put(left, size, first, n)
    groups = sorted((first, n, size - left) for (left, size), own in held.items() for first, n in own)
    starts = [g[0] for g in groups]
    cut = []
    for length, low, high, first, each, filled in runs:
        at = bisect.bisect_right(starts, first) - 1
        while low <= high:  # the bins of a run may have been parted by later lengths
            begin, n, used = groups[at]
            stop = min(high, low + (begin + n - first) * each - 1)
            cut.append((length, low, stop, first, each, filled, min(s for s in sizes if s >= used), used))
            low, first, at = stop + 1, begin + n, at + 1
    return cut


def pieces(docs: DataFrame, id_col: str, text_col: str, largest: int) -> DataFrame:
    """(doc_id, piece, start, length) of every document."""
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    cut = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"))
    cut = cut.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / largest))))
    start = F.col("piece") * largest
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.col("size") - start, F.lit(largest).cast("long")).alias("length"))


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, id_col: str = "doc_id", text_col: str = "text", use: float = USE) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_size, bin_used, bin_offset), a row for every piece."""
    spark = docs.sparkSession
    found = ranked(pieces(docs, id_col, text_col, max(sizes)), ["length"], ["doc_id", "piece"], "rank")
    found = stash(found, "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().toLocalIterator()}  # at most max(sizes) rows
    names = "run_length long, first_rank long, last_rank long, first_bin long, each long, filled long, bin_size int, bin_used int"
    planned = plan(counts, sizes, use) or [(0, 0, -1, 0, 1, 0, 0, 0)]
    runs = spark.createDataFrame(planned, names)
    on_run = (found["length"] == runs.run_length) & found["rank"].between(runs.first_rank, runs.last_rank)
    within = F.col("rank") - F.col("first_rank")
    offset = F.col("filled") + within % F.col("each") * F.col("length")
    return found.join(hinted(runs, 8 * len(planned)), on_run).select(
        "doc_id", "piece", "start", F.col("length").cast("int").alias("length"), (F.col("first_bin") + F.floor(within / F.col("each"))).alias("bin_id"),
        "bin_size", "bin_used", offset.cast("int").alias("bin_offset"),
    )
