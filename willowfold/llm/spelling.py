"""Spelling variants: words one letter apart, found by bit-sliced position indexes, and the form that each word is a variant of.

Words are near if one inserted, deleted or replaced code point makes one of the other.  A word's form is its most frequent near
word, ties by code points, if that is at least RATIO times as frequent; its root is where following forms ends.

Method: an index over a block of words has a bitset for each (position, letter), a bit a word.  A word is sought by reading its
letters once: the set without an error is cut by the letter's bitset, the sets with one error by that of the same position
(a replaced letter) or of the next one (a letter more in the found word), and each takes what the first one loses.  Words of 64 are advanced
by one operation, and many sought words by one numpy call.

Blocks: two words of lengths l, and l or l + 1, that are near have in common either their first h letters or their last l - h.  So
a word goes to two blocks as the shorter one and to two as the longer one, by halves.  A block of more than LIMIT words is cut again where the difference
may lie, until one position is left; by then it has no more words than there are pairs of letters.  No pair of
words is listed but near ones, and a block fits one task, whatever the table holds.

Defined results: null texts have no words; a null id counts as an empty text before the colon; repeated rows count repeatedly; words are in the lower case of A-Z only;
an empty table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.llm.shared import hinted, stash
from willowfold.sources.shared_dir import discard

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
SLIPS = 97
LIMIT = 2048


def runs_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = MIN_LENGTH) -> DataFrame:
    """(id, run): every maximal run of letters of at least ``shortest``, in lower case."""
    # a match begins where a run begins: had it failed there, it would fail on what is left of the run
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))


def slipped(run: Column, ident: Column) -> Column:
    """The run as typed: if SLIPS divides the CRC-32 of "id:run", the letter at that number modulo the length is lost."""
    h = F.crc32(F.concat(ident, F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(runs: DataFrame, word: Column, shortest: int = MIN_LENGTH, least: int = MIN_COUNT) -> DataFrame:
    """(word, n): words long enough that occur often enough."""
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (size, head, tail, word, n) with the key of their block: the shorter length, and the letters in common at both ends."""
    ends = F.concat_ws(" ", "size", "head", "tail", F.substring("word", F.lit(1), F.col("head")), F.when(F.col("tail") > 0, F.right("word", F.col("tail"))).otherwise(""))
    return rows.withColumn("key", ends)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in two blocks instead of one: the difference lies behind the middle of what is open, or before it."""
    middle = F.floor((F.col("size") + F.col("head") - F.col("tail") + 1) / 2).cast("int")  # head < middle <= size - tail
    both = F.array(F.struct(middle.alias("head"), F.col("tail")), F.struct(F.col("head"), (F.col("size") - middle).alias("tail")))
    return rows.select("size", F.explode(both).alias("cut"), "word", "n").select("size", "cut.head", "cut.tail", "word", "n")


def blocks(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, size, word, n): every word in its blocks of at most limit words, or as many as differ at one place only."""
    length = F.length("word")
    sizes = F.explode(F.array(length, length - 1))
    rows = words.select(sizes.alias("size"), F.lit(0).alias("head"), F.lit(0).alias("tail"), "word", "n")
    rows = stash(_keyed(_halves(rows)), "blocks")
    done = []
    while True:
        large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.first(F.col("size") - F.col("head") - F.col("tail")).alias("open")).where((F.col("m") > limit) & (F.col("open") > 1)).select("key")
        large = stash(large, "large_blocks")
        if not (count := large.count()):
            done.append(rows)
            break
        again = rows.join(hinted(large, count), "key", "left_semi")
        done.append(rows.join(hinted(large, count), "key", "left_anti").select(rows.columns))
        rows = stash(_keyed(_halves(again)), "blocks").select(rows.columns)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole.select("key", "size", "word", "n")


def near_in(words: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different words, i of length size and j of the same or one more, that are near; those of one length both ways."""
    m, spots = len(words), size + 1
    codes = np.zeros((m, spots), np.uint32)
    for i, word in enumerate(words):
        codes[i, : len(word)] = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    wide = -(-m // 64) * 64
    letters, slices = [], []
    for p in range(spots):
        own, which = np.unique(codes[:, p], return_inverse=True)
        bits = np.zeros((len(own) + 1, wide), bool)  # a last row, empty, for letters that no word has here
        bits[which, np.arange(m)] = True
        letters.append(own)
        slices.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
    longer = codes[:, size] != 0
    masks = np.zeros((2, wide), bool)
    masks[0, :m], masks[1, :m] = ~longer, longer
    same, more = np.packbits(masks, axis=1, bitorder="little").view(np.uint64)

    def holding(p: int, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(letters[p], asked), len(letters[p]) - 1)
        return slices[p][np.where(letters[p][at] == asked, at, len(letters[p]))]

    sought = np.flatnonzero(~longer)
    step = max(1, (1 << 17) // (wide // 64))
    for begin in range(0, len(sought), step):
        own = sought[begin : begin + step]
        exact = np.broadcast_to(same | more, (len(own), wide // 64))
        replaced, added = np.zeros_like(exact), np.zeros_like(exact)
        for p in range(size):
            asked = codes[own, p]
            here, next_ = holding(p, asked), holding(p + 1, asked)
            replaced = (replaced & here) | (exact & ~here)
            added = (added | exact) & next_
            exact = exact & here
            if not p % 16 and not (exact.any() or replaced.any() or added.any()):
                break
        found = (replaced & same) | ((added | exact) & more)
        i, j = np.nonzero(np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little"))
        yield own[i], j


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of blocks, which come sorted by size and key; whole blocks of one size share an index while it has fewer than LIMIT words."""
    pool: dict[str, int] = {}
    block: dict[str, int] = {}
    now = None

    def made(size: int) -> Iterator[pa.RecordBatch]:
        words, n = list(pool), np.fromiter(pool.values(), np.int64, len(pool))
        column = pa.array(words, pa.string())
        for i, j in near_in(words, size):
            one = np.array([len(words[x]) == size for x in j], bool)  # those are found from both sides
            a, b = np.concatenate([i, j[~one]]), np.concatenate([j, i[~one]])
            for k in range(0, len(a), 65536):
                x, y = a[k : k + 65536], b[k : k + 65536]
                yield pa.RecordBatch.from_arrays([column.take(pa.array(x)), column.take(pa.array(y)), pa.array(n[y])], ["word", "other", "other_n"])

    for batch in batches:
        for key, size, word, count in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if now != (size, key):
                if len(block) > 1:
                    pool |= block
                block = {}
                if now and pool and (len(pool) >= LIMIT or size != now[0]):
                    yield from made(now[0])
                    pool = {}
                now = (size, key)
            block[word] = count
    if len(block) > 1:
        pool |= block
    if pool:
        yield from made(now[0])


def near_words(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, other, other_n): the near words of each word, a pair as often as blocks of both hold it."""
    rows = blocks(words, limit).select("key", "size", "word", "n")
    return rows.repartition("key").sortWithinPartitions("size", "key").mapInArrow(_near, "word string, other string, other_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling steps; forms become more frequent, so there are no circles and few steps."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stash(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(now)
        now = step
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        at = now._kept_at
        now = now.drop("moved")
        now._kept_at = at


def variants(words: DataFrame, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word (word, n)."""
    words = stash(words, "words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word"))).alias("best")
    near = near_words(words, limit).groupBy("word").agg(F.count_distinct("other").alias("n_near"), best)
    form = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    found = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.n")).alias("form_n"))
    found = stash(found, "forms")
    last = roots(found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def of_documents(docs: DataFrame) -> DataFrame:
    """The variants among the words of documents with planted slips."""
    return variants(vocabulary(runs_of(docs), slipped(F.col("run"), F.col("id"))))


#: CRC-32 bit by bit; near words by what is left without one letter.
ORACLE = rf"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::varchar, '') AS id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
counted AS (SELECT id || ':' || run AS k, run, count(*) AS times FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY 1, 2),
bytes AS (SELECT *, list_transform(range(octet_length(encode(k))), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::UBIGINT) AS b FROM counted),
crc AS (SELECT *, xor(list_reduce(list_concat([4294967295::UBIGINT], b), lambda acc, x:
          list_reduce([xor(acc, x), 1, 2, 3, 4, 5, 6, 7, 8]::UBIGINT[], lambda a, _: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::UBIGINT) ELSE a // 2 END)), 4294967295::UBIGINT) AS h FROM bytes),
typed AS (SELECT CASE WHEN h % {SLIPS} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM crc),
words AS (SELECT word, sum(times)::BIGINT AS n FROM typed WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(times) >= {MIN_COUNT}),
less AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, min({{n: -other_n, word: encode(other)}}) AS best FROM pairs GROUP BY word),
forms AS (SELECT w.word, CASE WHEN -(best).n >= {RATIO} * w.n THEN decode((best).word) END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -(best).n >= {RATIO} * w.n THEN -(best).n END AS form_n
          FROM words w LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.at AS root FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
