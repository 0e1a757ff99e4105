"""Language identification by the nearest of several centroids per language.

A text's vector holds the hashed counts of its byte trigrams (lower case, everything but letters a blank), damped
by a logarithm, weighted by inverse document frequency and normalised.  Each language has up to CENTROIDS
centroids from spherical k-means, and a text gets the language of the centroid nearest by cosine.  A text farther
from every centroid than ``max_distance``, or less like the nearest one than the bar for its length, is rejected.

The bars come from the scores of all learning rows and of a beginning of each (1 to 512 words, by turns), by language
and by the number of different n-grams (powers of two): MARGIN of the score that all but the LOW lowest reach, but not under
FLOOR of the median, so that a few foreign rows among the learned ones do not lower the bar to their own scores.  A
shorter text never has a higher bar than a longer one; lengths that no learning row has take the next shorter one's.

Document frequencies are counted over all learning rows.  Only the clustering runs on a sample: the SAMPLE learning
rows of each language with the least hash of their id, a bound that does not depend on the table.  What reaches the driver grows with the number of
languages: about twice SAMPLE sparse rows and CLASSES * BINS counts for each.

Defined results: a null text or one without a letter is ``und`` with score 0, and rejected; very short texts are
classified like others; ties go to the language first in order; a table without any labelled row gives ``und``
everywhere, and drop_rejected keeps its rows; repeated rows count repeatedly; null labels are not learned from; extra columns are not read.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.llm.shared import small_batches

BITS = 16
DIMENSIONS = 1 << BITS
SAMPLE = 400
CENTROIDS = 4
MAX_DISTANCE = 0.97
LOW, MARGIN, FLOOR = 0.001, 0.3, 0.15
BINS = 1000
CLASSES = BITS + 1
UND = "und"
#: Labels beyond this number are refused: the model has a megabyte for each, and is sent to every executor.
MAX_LANGUAGES = 256

_KEEP = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(text: str) -> np.ndarray:
    """Hashed trigrams of one whole text."""
    data = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)].astype(np.uint32)
    h = data[:-2] * _MIX[0] + data[1:-1] * _MIX[1] + data[2:] * _MIX[2]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    inner = (data[1:-1] != 32) | (data[:-2] != 32) & (data[2:] != 32)
    return (h >> np.uint32(32 - BITS))[inner]


def counts(text: str) -> np.ndarray:
    """Hashed trigram counts of one whole text."""
    return np.bincount(grams(text), minlength=DIMENSIONS)


def length_class(different: int) -> int:
    """The power of two below a number of different n-grams."""
    return max(0, different.bit_length() - 1)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vectors(rows: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, zero for texts without n-grams."""
    weighted = np.log1p(np.array(rows, np.float32).reshape(len(rows), DIMENSIONS)) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return weighted / np.where(norm > 0, norm, 1)


def clustered(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k spherical k-means centroids, started far from each other."""
    centres = [points.mean(axis=0)]
    while len(centres) < min(k, len(points)):
        near = np.max(points @ np.array(centres).T, axis=1)
        centres.append(points[int(np.argmin(near))])
    centres = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(points @ centres.T, axis=1)
        centres = np.array([points[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


class Model:
    """Weights of n-grams, the centroids with their languages, and the bars by language and length class."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, languages: list[str], max_distance: float = MAX_DISTANCE, bars: dict[str, list[float]] | None = None):
        self.idf, self.languages, self.max_distance, self.bars = idf, languages, max_distance, bars or {}
        self.by_gram = np.ascontiguousarray(centroids.T, np.float32)  # a row for each n-gram, the one copy that travels

    @property
    def centroids(self) -> np.ndarray:
        return self.by_gram.T

    def nearest(self, text: str) -> tuple[str, float, int]:
        """(language, score, length class) of a text with a letter."""
        gram, n = np.unique(grams(text), return_counts=True)
        weights = np.log1p(n.astype(np.float32)) * self.idf[gram]
        near = weights @ self.by_gram[gram] / (float(np.linalg.norm(weights)) or 1.0)
        best = int(np.argmax(near))
        return self.languages[best], min(1.0, max(0.0, float(near[best]))), length_class(len(gram))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        found = []
        for text in texts:
            if not self.languages or not has_letter(text):
                found.append((UND, 0.0, True))
                continue
            lang, score, size = self.nearest(text)
            found.append((lang, score, 1 - score > self.max_distance or lang in self.bars and score < self.bars[lang][size]))
        return found


def bars_of(held: dict[str, np.ndarray]) -> dict[str, list[float]]:
    """The bars of each language from its counts of learning scores, (length class, bin)."""
    found = {}
    for lang, own in held.items():
        bars = np.full(CLASSES, np.nan)
        for size in range(CLASSES):
            if n := own[size].sum():
                low, middle = np.searchsorted(np.cumsum(own[size]), [max(1, LOW * n), n / 2]) / BINS
                bars[size] = max(MARGIN * low, FLOOR * middle)
        least, below = np.inf, []
        for bar in bars[::-1]:
            least = least if np.isnan(bar) else min(least, bar)
            below.append(bar if np.isnan(bar) else least)
        bars, last = below[::-1], 0.0
        for size, bar in enumerate(bars):
            bars[size] = last = last if np.isnan(bar) else float(bar)
        found[lang] = bars
    return found


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Counts of the scores of learning rows and their beginnings, where the label is the language found."""
    total = {lang: np.zeros((CLASSES, BINS), np.int64) for lang in model.languages}
    for batch in batches:
        for lang, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for part in (text, " ".join(text.split(None, 512)[: 1 << h % 10])):
                if has_letter(part):
                    found, score, size = model.nearest(part)
                    if found == lang:
                        total[lang][size, min(BINS - 1, int(score * BINS))] += 1
    for lang, own in total.items():
        size, at = np.nonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(size), pa.string()), pa.array(size, pa.int32()), pa.array(at, pa.int32()), pa.array(own[size, at])], ["lang", "size", "bin", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMENSIONS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total[np.unique(grams(text))] += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], ["gram", "n"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [np.array(np.unique(grams(t), return_counts=True), np.uint32).tobytes() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "h", "counts"])


def _centroids(rows: list[np.ndarray], idf: np.ndarray, k: int) -> np.ndarray:
    """Centroids of sparse rows (n-grams, counts), clustered over the n-grams that any of them has."""
    used = np.unique(np.concatenate([gram for gram, _ in rows]))
    points = np.zeros((len(rows), len(used)), np.float32)
    for point, (gram, n) in zip(points, rows, strict=True):
        weights = np.log1p(n.astype(np.float32)) * idf[gram]
        point[np.searchsorted(used, gram)] = weights / (np.linalg.norm(weights) or 1)
    own = clustered(points, k)
    found = np.zeros((len(own), DIMENSIONS), np.float32)
    found[:, used] = own
    return found


def fit(learn: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS, max_distance: float = MAX_DISTANCE) -> Model:
    """A model from the labelled rows of learn."""
    small_batches(learn.sparkSession)
    rows = learn.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, F.length(text_col)).alias("h"), F.col(text_col).alias("text"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels in {lang_col}: they are no languages")
    df = np.zeros(DIMENSIONS)
    for r in rows.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        df[r["gram"]] = r["n"]
    idf = (np.log((1 + sum(n.values())) / (1 + df)) + 1).astype(np.float32)
    # twice the wanted share of the hash range holds at least the wanted rows almost surely; the exact cut follows
    cuts = [(lang, int(-(1 << 63) + min(1.0, 2 * sample / held + 20 / held) * ((1 << 64) - 1025))) for lang, held in sorted(n.items())]
    cuts = F.broadcast(learn.sparkSession.createDataFrame(cuts, "lang string, cut long"))  # MAX_LANGUAGES rows at most
    picked = rows.join(cuts, "lang").where("h <= cut").select("lang", "h", "text").mapInArrow(_sampled, "lang string, h long, counts binary").collect()
    by: dict[str, list] = {lang: [] for lang in sorted(n)}
    for r in sorted(picked, key=lambda r: (r["h"], bytes(r["counts"]))):
        if len(by[r["lang"]]) < sample:
            by[r["lang"]].append(np.frombuffer(r["counts"], np.uint32).reshape(2, -1))
    found = {lang: _centroids(own, idf, centroids) for lang, own in by.items() if own}
    languages = [lang for lang, own in found.items() for _ in own]
    model = Model(idf, np.concatenate(list(found.values())) if found else np.zeros((0, DIMENSIONS)), languages, max_distance)
    shared = learn.sparkSession.sparkContext.broadcast(model)  # centroids of each language, whatever the table's size
    scores = rows.select("lang", "h", "text").mapInArrow(lambda it: _scored(it, shared.value), "lang string, size int, bin int, n long")
    held = {lang: np.zeros((CLASSES, BINS), np.int64) for lang in languages}
    for r in scores.groupBy("lang", "size", "bin").agg(F.sum("n").alias("n")).collect():  # at most CLASSES * BINS for each language
        held[r["lang"]][r["size"], r["bin"]] = r["n"]
    return Model(idf, model.centroids, languages, max_distance, bars_of(held))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row; only the text is an input of the prediction."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of each language, whatever the table's size
    kind = docs.schema[id_col].dataType.simpleString()

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shared.value.predict(batch.column(1).to_pylist())
            columns = zip(*found, strict=True) if found else ([], [], [])
            arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(predicted, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_rejected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the rows that the distance rule rejects, all columns as they were.

    Where no row has a label there is nothing to be far from: all rows stay, and a warning says so.
    """
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    if not model.languages:
        warnings.warn(f"no row has a label in {lang_col}, so no row can be rejected", stacklevel=2)
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids of each language, whatever the table's size
    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not rejected for _, _, rejected in shared.value.predict(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)  # row by row, whatever the ids
