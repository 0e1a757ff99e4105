"""Exact dedup through an extendible-hash index in shared files, in DataFrame operations only.

Every row has an entry: doc_id, the 64-bit hash of its normalised text and the text's SHA-256.  Entries of one
hash and SHA-256 fold first, map-side, so that a group of copies is one entry of the index however large it is.

The first bits of the hash point into the directory.  The directory starts at depth 0 and doubles: a bucket that
holds more than ``capacity`` entries is split by one more bit, so each slot has the depth of its bucket.  Capacity
and bits follow from the number of entries unless given: the directory has some 2**DIRECTORY_BITS slots at most, and
buckets fit before the last depth; where given bits are too few, a bucket of the last depth keeps what it has.

A bucket is a range of hashes.  Each owner task takes a range of buckets and marks the chains among its entries, the
hashes with several rows or several SHA-256; the index is written so.  Only texts of hashes in a chain are read
again and compared byte by byte, by grouping on hash and whole normalised text; copies fold inside the tasks that
read them before anything is shuffled.

Defined results: a null text counts as empty; a row with a null doc_id has the answer of its group and is
kept only if it is alone in its group; repeated rows of one doc_id count as members and share one answer; an
empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from willowfold.llm.shared import hinted, keyed, stash, without_rows

DIRECTORY_BITS = 18
CAPACITY = 8192
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def bits_for(entries: int, capacity: int) -> int:
    """Bits that part so many entries into buckets of the capacity, and three to spare."""
    return max(1, -(-entries // capacity) - 1).bit_length() + 3


def slot(bits: int) -> Column:
    return F.expr(f"cast(shiftrightunsigned(h, {64 - bits}) as int)")


def directory(filled: DataFrame, capacity: int, bits: int) -> DataFrame:
    """(slot, depth, bucket) for every slot in use, from (slot, n), the number of entries in it."""
    levels = filled.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    levels = levels.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {bits} - depth)"))
    held = levels.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    fits = held.where((F.col("held") <= capacity) | (F.col("depth") == bits))
    levels = levels.select("slot", "depth", "bucket").join(fits, ["depth", "bucket"])
    return levels.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("b")).select("slot", "b.depth", "b.bucket")


def entries_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, sha) of every row, written to the shared folder."""
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t"))
    return stash(text.select("doc_id", F.xxhash64("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "entries")


def build_index(entries: DataFrame, capacity: int | None = None, bits: int | None = None) -> DataFrame:
    """The index (depth, bucket, h, sha, copies, chained), an entry for each text, read from the files that owner tasks wrote."""
    folded = stash(entries.groupBy("h", "sha").agg(F.count(F.lit(1)).alias("copies")), "folded")
    n = folded.count()
    capacity = capacity or max(CAPACITY, n >> (DIRECTORY_BITS - 3))
    bits = bits or bits_for(n, capacity)
    slots = stash(directory(folded.groupBy(slot(bits).alias("slot")).agg(F.count(F.lit(1)).alias("n")), capacity, bits), "directory")
    placed = folded.withColumn("slot", slot(bits)).join(hinted(slots, 1 << bits), "slot")
    first = F.expr(f"shiftleft(cast(bucket as long), {bits} - depth)")
    owned = placed.select(first.alias("first_slot"), "depth", "bucket", "h", "sha", "copies").repartitionByRange("first_slot")
    chain = Window.partitionBy("first_slot", "h")  # within the owner's range, so nothing moves
    owned = owned.withColumn("chained", (F.col("copies") > 1) | (F.count(F.lit(1)).over(chain) > 1))
    return stash(owned.drop("first_slot"), "index")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None, bits: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs."""
    entries = entries_of(docs, id_col, text_col)
    index = build_index(entries, capacity, bits)
    chains = stash(index.where("chained").select("h").distinct(), "chains")
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t")).withColumn("h", F.xxhash64("t"))
    members = texts.join(hinted(chains, chains.count()), "h", "left_semi")
    equal = members.groupBy("h", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    equal = stash(equal.select("h", F.unhex(F.sha2("t", 256)).alias("sha"), "keep_id", "group_size"), "equal")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    return entries.join(equal, ["h", "sha"], "left").select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"), F.coalesce(keep == F.col("doc_id"), size == 1).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group, the one with the smallest id (null only if none has one), all columns as they were.

    Rows are told apart by keys, not ids: repeated rows are dropped, and rows of one id with other texts stay.
    """
    rows, key = keyed(docs, id_col)
    return without_rows(rows, exact_groups(rows, key, text_col).where("not kept"), key)


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
