"""Resharding by minimum-cost flow: row counts made even with the fewest bytes moved, and the files rewritten.

The old layout gives every row a shard.  The new one has ``shards`` shards whose row counts differ by one at most.
Rows stay where they are as far as the new capacity allows; a shard with too many gives its smallest rows, since
each row moved counts its bytes.  Which shards get the one row more is part of the flow: giving it to a full
shard spares the move of that shard's largest candidate.  So each old shard has a block that must move and a
block of one row that may; a flow of least cost over these blocks decides the transfers between shards.

The network has a few nodes for each shard and none for rows; only counts and one candidate row of each shard reach
the driver.  Rows are ranked by (size, id, CRC) within their old shard, and a transfer is a range of ranks.  A rank
finds its row by its place (size, id, CRC): almost every place has one row, and whole places are told by a broadcast
table of transfers where the texts are read.  Where several rows share a place that a transfer's end cuts, or very
many do, they are written with numbers of their own, which are ranks when added to the place's first, so exactly the
planned rows move.

Law: ``rows`` - the counts of shards are at most one apart.

Every shard that gave or got rows is written to a folder of its own, with all columns, in files of even bytes; the
others are not touched.  A slot is a row's place in its shard's files.

Defined results: a null text has 16 bytes and the CRC of no bytes; rows with equal ids or texts, whole repeated rows
too, are rows of their own and the law holds for them; a null source belongs to an old shard of its own; slots of
shards that stay follow size, id and CRC; an empty table gives no rows and writes no shard; columns of docs are
written whatever their names.  docs is read several times and must give the same rows each time, as tables do.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from willowfold.llm.shared import free_name, hinted, numbered, ranked, stash
from willowfold.sources.shared_dir import new_dir

SHARDS = 40
OLD_SHARDS = 32
HEADER = 16
#: Bytes of text in a file, and in a task that writes one; rows of one place from which on they are dealt out by numbers.
FILE_BYTES = 64 << 20
TIED_ROWS = 10_000
PLACE = ["size", "id", "crc"]


def least_cost_flow(nodes: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of the largest flow of least cost, by shortest augmenting paths."""
    heads, room, cost, out = [], [], [], [[] for _ in range(nodes)]
    for a, b, most, price in arcs:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(heads))
            heads.append(y)
            room.append(r)
            cost.append(c)
    while True:
        dist, via, queued = [None] * nodes, [-1] * nodes, [False] * nodes
        dist[source], queue = 0, deque([source])
        while queue:
            x = queue.popleft()
            queued[x] = False
            for e in out[x]:
                y, d = heads[e], dist[x] + cost[e]
                if room[e] and (dist[y] is None or d < dist[y]):
                    dist[y], via[y] = d, e
                    if not queued[y]:
                        queued[y] = True
                        queue.append(y)
        if dist[sink] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        path, y = [], sink
        while y != source:
            path.append(via[y])
            y = heads[via[y] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def transfers(held: dict[int, int], shards: int, spare_bytes: dict[int, int], block_bytes: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, first rank, last rank) of the rows that move, by rank from the smallest row up.

    held: rows of each old shard.  spare_bytes: bytes of the row that a shard need not give if it gets the one row more.
    block_bytes: bytes of the rows below it, which move in any case.
    """
    total = sum(held.values())
    base, extra = divmod(total, shards)
    old = sorted(held)
    source, sink, hub, bonus = 0, 1, 2, 3
    of_old = {s: 4 + i for i, s in enumerate(old)}
    of_new = {t: 4 + len(old) + t for t in range(shards)}
    arcs, moving = [], {}
    for s in old:
        arcs.append((source, of_old[s], held[s], 0))
        if s < shards:
            arcs.append((of_old[s], of_new[s], held[s], 0))
        must = max(0, held[s] - base - 1) if s < shards else held[s]
        if must:  # blocks are ordered by the size of their rows, so the mean orders them too
            moving[s] = [len(arcs)]
            arcs.append((of_old[s], hub, must, block_bytes.get(s, 0) // must))
        if s < shards and held[s] > base:
            moving.setdefault(s, []).append(len(arcs))
            arcs.append((of_old[s], hub, 1, spare_bytes.get(s, 0)))
    into = {}
    for t in range(shards):
        into[t] = len(arcs)
        arcs.append((hub, of_new[t], total, 0))
        arcs.append((of_new[t], sink, base, 0))
        arcs.append((of_new[t], bonus, 1, 0))
    arcs.append((bonus, sink, extra, 0))
    flow = least_cost_flow(4 + len(old) + shards, arcs, source, sink)
    given = deque((s, sum(flow[i] for i in moving[s])) for s in old if s in moving)
    found, rank = [], 0
    for t in range(shards):
        need = flow[into[t]]
        while need:
            s, left = given.popleft()
            if not left:
                continue
            n = min(need, left)
            found.append((s, t, rank, rank + n - 1))
            need, rank = need - n, rank + n
            if n < left:
                given.appendleft((s, left - n))
            else:
                rank = 0
    return found


def described(docs: DataFrame, old_shard: Column, id_col: str, text_col: str) -> DataFrame:
    """(old_shard, size, id, crc, row) of every row, row being all its columns; a null id comes before all others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + HEADER).cast("long").alias("size")
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id")
    return docs.select(old_shard.cast("int").alias("old_shard"), size, own, F.crc32(F.encode(text, "UTF-8")).alias("crc"), F.struct("*").alias("row"))


def old_layout(rows: DataFrame) -> DataFrame:
    """(old_shard, size, id, crc, rank) of every described row: its rank in its old shard, smallest first."""
    return stash(ranked(rows.select("old_shard", *PLACE), ["old_shard"], PLACE, "rank"), "old-layout")


def planned(order: DataFrame, shards: int) -> list[tuple[int, int, int, int]]:
    """The transfers of least cost for an old layout; a few numbers for each old shard reach the driver."""
    spark = order.sparkSession
    held = {r["old_shard"]: r["count"] for r in order.groupBy("old_shard").count().collect()}
    base = sum(held.values()) // shards
    must = {s: max(0, n - base - 1) if s < shards else n for s, n in held.items()}
    musts = F.broadcast(spark.createDataFrame([*must.items()] or [(-1, 0)], "old_shard int, must long"))
    known = order.join(musts, "old_shard")
    costs = known.groupBy("old_shard").agg(F.sum(F.when(F.col("rank") < F.col("must"), F.col("size"))).alias("block"), F.sum(F.when(F.col("rank") == F.col("must"), F.col("size"))).alias("spare")).collect()
    return transfers(held, shards, {r["old_shard"]: r["spare"] or 0 for r in costs}, {r["old_shard"]: r["block"] or 0 for r in costs})


def tied_places(order: DataFrame, moves: list[tuple[int, int, int, int]], most: int = TIED_ROWS) -> DataFrame:
    """(old_shard, size, id, crc, first) of places with several rows that a transfer's end cuts, or with more than ``most`` rows."""
    spark = order.sparkSession
    cuts = {(s, r) for s, _, low, high in moves for r in (low, high + 1) if r}
    ends = F.broadcast(spark.createDataFrame([*cuts] or [(-1, -1)], "old_shard int, cut long"))  # at most two for each pair of shards
    several = order.groupBy("old_shard", *PLACE).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stash(several, "several")
    cut = several.join(ends, "old_shard").where("first < cut and cut < first + n").select("old_shard", *PLACE, "first")
    return stash(cut.union(several.where(F.col("n") > most).select("old_shard", *PLACE, "first")).distinct(), "tied")


def assign(rows: DataFrame, order: DataFrame, moves: list[tuple[int, int, int, int]], most: int = TIED_ROWS) -> DataFrame:
    """Described rows with ``shard``, their new one, and ``number`` among the tied rows of their place, else 0."""
    spark = rows.sparkSession
    ends = {(s, r) for s, _, low, high in moves for r in (low, high + 1)}
    marks = F.broadcast(spark.createDataFrame([*ends] or [(-1, -1)], "old_shard int, rank long"))
    at = {(r["old_shard"], r["rank"]): tuple(r[c] for c in PLACE) for r in order.join(marks, ["old_shard", "rank"]).collect()}  # at most two a transfer
    ranges = [(s, t, low, high, at[s, low], at.get((s, high + 1))) for s, t, low, high in moves]
    place = "struct<size: long, id: long, crc: long>"
    table = F.broadcast(spark.createDataFrame(ranges or [(-1, -1, -1, -1, None, None)], f"from_shard int, to_shard int, low_rank long, high_rank long, low {place}, high {place}"))
    tied = tied_places(order, moves, most)
    n = tied.count()
    alone = rows.join(hinted(tied, n), ["old_shard", *PLACE], "left_anti") if n else rows
    own = F.struct(*PLACE)
    within = (alone.old_shard == table.from_shard) & (own >= table.low) & (table.high.isNull() | (own < table.high))
    found = alone.join(table, within, "left").select(*rows.columns, F.coalesce("to_shard", "old_shard").alias("shard"), F.lit(0).cast("long").alias("number"))
    if not n:
        return found
    keys = ["old_shard", *PLACE]
    several = numbered(rows.join(hinted(tied, n), keys).sortWithinPartitions(*keys), keys, "number", "tied-rows")
    rank = F.col("first") + F.col("number")
    within = (several.old_shard == table.from_shard) & rank.between(table.low_rank, table.high_rank)
    return found.unionByName(several.join(table, within, "left").select(*rows.columns, F.coalesce("to_shard", "old_shard").alias("shard"), "number"))


def write(found: DataFrame, changed: list[int], path: str, shard_col: str, file_bytes: int = FILE_BYTES) -> None:
    """Write the rows of changed shards to ``path/<shard_col>=<shard>``.

    A shard has parts by its bytes, at most file_bytes each on average, and a row's part is a hash of its place and number; so no task holds more
    than a part, and a part is a file.
    """
    spark = found.sparkSession
    rows = found.where(F.col("shard").isin(changed))
    sizes = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}  # a row for each shard
    parts, first = [], 0
    for shard, held in sorted(sizes.items()):
        n = -(-held // file_bytes)
        parts.append((shard, first, n))
        first += n
    table = F.broadcast(spark.createDataFrame(parts, "shard int, first_part int, parts int"))
    part = F.col("first_part") + F.pmod(F.xxhash64(*PLACE, "number"), F.col("parts"))
    placed = rows.join(table, "shard").withColumn("part", part.cast("int")).repartitionById(first, "part")
    placed = placed.sortWithinPartitions("shard", *PLACE, "number").select("row.*", F.col("shard").alias(shard_col))
    placed.write.option("compression", "zstd").partitionBy(shard_col).parquet(path)


def read_slots(spark: SparkSession, path: str, shard_col: str, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row of the shard folders below path, from the rows read."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the place in the file takes the place of texts, so what is counted and joined is narrow
    rows = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + HEADER).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.col(shard_col).cast("int").alias("shard"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = spark.read.parquet(path).select(F.col(shard_col).cast("int").alias("shard"), F.col("_metadata.file_name").alias("file")).groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = stash(files.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "file-starts")
    return rows.join(hinted(starts, starts.count()), ["shard", "file"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("at")).alias("slot"))


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, file_bytes: int = FILE_BYTES, tied_rows: int = TIED_ROWS) -> DataFrame:
    """Write the folder of every shard that gave or got rows below path, by default a new shared one; (doc_id, size, text_crc32, shard, slot) of all rows.

    What is returned of rewritten shards is read from their files; other shards keep what they have, so their rows come from docs.
    """
    spark = docs.sparkSession
    path = path or new_dir(spark, "shards")
    rows = described(docs, old_shard, id_col, text_col)
    order = old_layout(rows)
    moves = planned(order, shards)
    changed = sorted({s for move in moves for s in move[:2] if s < shards})
    leaving = sorted({s for s, *_ in moves})
    null_id = F.when(F.col("id") != -(1 << 63), F.col("id"))
    stay = order.where(~F.col("old_shard").isin([*changed, *leaving])) if moves else order
    kept = stay.select(null_id.alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("old_shard").alias("shard"), F.col("rank").alias("slot"))
    if not moves:
        return kept
    shard_col = free_name(docs.columns, "shard")
    write(assign(rows, order, moves, tied_rows), changed, path, shard_col, file_bytes)
    return read_slots(spark, path, shard_col, id_col, text_col).unionByName(kept)
