"""A hierarchical Pitman-Yor language model over all training tokens, and the log probability of every text under it.

Each word seen is the context of the next one and has a restaurant; all restaurants share one parent, the root, over a uniform base.
A restaurant seats its customers, the tokens that followed its context, at tables of one word each; every table sends a
customer to the root.  Gibbs sweeps take customers up at random and seat them again: at a table of their word by its size less the discount,
or at a new one by (strength + discount * tables) * the root's probability.  Discount and strength are drawn by Teh's auxiliary
variables.  A probability is the mean of what the samples after the burn-in predict, and texts are scored by its logarithm.

Layout.  Texts are dealt in chunks of about CHUNK tokens; only arrays move.  (1) A chunk sends its different words to owners, by hash, which count
them and give them numbers, the frequent ones first.  (2) A chunk sends its different pairs (context, word) with the documents that hold them to the part
that has the context's restaurant, about PART tokens each; a context of more than HOT tokens is dealt over several parts by the word, which
tell each other their numbers of tables.  (3) Parts send their tables, summed by word, to the owners, which hold the root's restaurant, seat it and tell its counts;
this is done ROUNDS times, and the parts' plan reads one shuffle of (2) each time.  (4) Parts send the sums of each document back by chunk.
Parts sample side by side against the root of the last round, and moves of one restaurant in one step see each other's tables one step
late; both are the usual ways of parallel Gibbs sampling.  A sweep seats all customers again: of a pair with up to PLAIN, as many are taken up, one after the other, as it
has; for a larger one the number of its tables is drawn at once, whatever its size, from its exact law given the restaurant's other tables (seatings.py).  Seeds are fixed, and messages are put in order, so that a task that is run again gives the same.

Tokens are words between ASCII white space, A-Z in lower case, and one end for each text, which also is the context of the next first word.

Defined results: null texts are empty and have the end only; rows without an id are learned from; repeated rows count repeatedly; an empty table gives none; with nothing
to learn from every token has the base's probability; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from willowfold.llm import seatings
from willowfold.llm.shared import small_batches, stash

CHUNK, PART, WORDS, HOT = 1 << 20, 1 << 20, 1 << 19, 1 << 20
ROUNDS, SWEEPS, BURN_IN, SAMPLES, PLAIN = 2, 3, 2, 4, 64
ADDED = 0.1
END = b"\n"  # no word holds white space
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in the least width, compressed."""
    values = np.ascontiguousarray(values)
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    return kind.char.encode() + zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.dtype(chr(data[0]))).astype(np.int64)


def compacted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, place of each value); by marks in place of a sort where the values are dense."""
    most = int(values.max(initial=0)) + 1
    if most > 8 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    there = np.zeros(most, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


class Numbers(dict):
    """A number for each new key, in their order."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... each as often as its length."""
    return np.repeat(np.arange(len(lengths)), lengths)


# ---- the model in one part ----


class Tables:
    """Tables of customers: ``size`` customers of each dish, some ``rows`` of dishes with more than one, their sizes in a matrix for each power of two.

    Of dishes with more than PLAIN customers, ``many``, only the number of tables is kept: predictions need no more.
    """

    def __init__(self, customers: np.ndarray, house: np.ndarray, houses: int):
        self.customers, self.house = customers, house
        self.tables = np.minimum(customers, 1)
        self.total = np.bincount(house, self.tables, houses)
        self.many = np.flatnonzero(customers > PLAIN)
        order = np.flatnonzero((customers > 1) & (customers <= PLAIN))
        power = np.frexp(customers[order].astype(float))[1]
        self.classes = [(own, customers[own][:, None].astype(np.int64)) for own in (order[power == k] for k in np.unique(power))]

    def sweep(self, rng: np.random.Generator, discount: float, strength: float, parent: np.ndarray, elsewhere: np.ndarray) -> None:
        """Take customers up and seat them again; elsewhere: tables of each house that are held in other tasks."""
        for k, (own, seats) in enumerate(self.classes):
            count, house = self.customers[own], self.house[own]
            n = count
            one = self.tables[own] == 1
            # whoever sits at the only table opens another by the same chance at each move, so the first time is drawn at once
            new = (strength + discount * (self.total[house] + elsewhere[house])) * parent[own]
            chance = np.minimum(new / (new + count - 1 - discount), 1 - 1e-12)
            wait = np.where(one, np.log(1 - rng.random(len(own))) / np.log1p(-np.maximum(chance, 1e-300)), 0)
            opens = np.flatnonzero(one & (wait < n))
            left = np.where(one, n - 1 - np.floor(np.minimum(wait, n)), n).astype(np.int64)
            if len(opens):
                if seats.shape[1] == 1:
                    seats = np.concatenate([seats, np.zeros_like(seats)], axis=1)
                at = np.argmax(seats[opens], axis=1)
                seats[opens, at] -= 1
                seats[opens, np.where(at == 0, 1, 0)] = 1
                self.tables[own[opens]] += 1
                np.add.at(self.total, house[opens], 1)
            active = np.concatenate([opens, np.flatnonzero(~one)])
            active = active[np.argsort(-left[active], kind="stable")]
            ends = np.searchsorted(-left[active], -np.arange(int(left[active].max(initial=0))))  # rows with more than so many moves left
            for end in ends:
                seats = self._moved(rng, seats, active[:end], own, discount, strength, parent, elsewhere)
            self.classes[k] = (own, seats)
        if len(self.many):
            self._drawn_many(rng, discount, strength, parent, elsewhere)

    def _drawn_many(self, rng: np.random.Generator, discount: float, strength: float, parent: np.ndarray, elsewhere: np.ndarray) -> None:
        """Tables of the large dishes.  Given a gamma variable for each house, its dishes do not depend on each other and each table has one factor."""
        houses, house = np.unique(self.house[self.many], return_inverse=True)
        held = self.total[houses] + elsewhere[houses]
        factor = discount * rng.gamma(strength / discount + held)[house] * parent[self.many]
        now = seatings.drawn(rng, self.customers[self.many], discount, factor)
        np.add.at(self.total, self.house[self.many], now - self.tables[self.many])
        self.tables[self.many] = now

    def _moved(self, rng: np.random.Generator, seats: np.ndarray, rows: np.ndarray, own: np.ndarray, discount: float, strength: float, parent: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
        """One customer of each of the rows is taken up and seated again."""
        dish = own[rows]
        house, sizes = self.house[dish], seats[rows]
        here = np.arange(len(rows))
        leaves = (rng.random(len(rows)) * self.customers[dish]).astype(np.int64)
        at = (np.cumsum(sizes, axis=1) <= leaves[:, None]).sum(axis=1)
        sizes[here, at] -= 1
        gone = sizes[here, at] == 0
        if gone.any():
            self.tables[dish] -= gone
            np.subtract.at(self.total, house[gone], 1)
        new = (strength + discount * (self.total[house] + elsewhere[house])) * parent[dish]
        held = np.cumsum(np.where(sizes > 0, sizes - discount, 0), axis=1)
        x = rng.random(len(rows)) * (held[:, -1] + new)
        opens = (x < new) | (held[:, -1] <= 0)
        to = np.minimum((held <= (x - new)[:, None]).sum(axis=1), sizes.shape[1] - 1)
        sizes[here[~opens], to[~opens]] += 1
        if opens.any():
            where = here[opens]
            free = np.argmin(sizes[where], axis=1)
            if (full := sizes[where, free] > 0).any():
                sizes, seats = (np.concatenate([x, np.zeros_like(x[:, :1])], axis=1) for x in (sizes, seats))
                free[full] = sizes.shape[1] - 1
            sizes[where, free] = 1
            self.tables[dish] += opens
            np.add.at(self.total, house[opens], 1)
        seats[rows] = sizes
        return seats

    def drawn(self, rng: np.random.Generator, discount: float, strength: float, customers: np.ndarray, seated: np.ndarray) -> tuple[float, float]:
        """(discount, strength) drawn given the seating, by auxiliary variables of the houses with customers, a house of several parts by what is here.

        Large dishes have no sizes of tables; they count by the sum over all of them, and the discount is then drawn by a slice.
        """
        tables = self.total[seated].astype(np.int64)
        several = tables > 1
        most = int(tables.max(initial=1))
        reach = np.cumsum(np.bincount(tables, minlength=most + 1)[::-1])[::-1][2 : most + 1]  # houses with more than i tables, i from 1
        i = np.arange(1, len(reach) + 1)
        from_strength = rng.binomial(reach, strength / (strength + discount * i)).sum() if len(i) else 0
        log_x = np.log(np.maximum(rng.beta(strength + 1, np.maximum(customers[seated][several] - 1, 1e-9)), 1e-300)).sum()
        sizes = np.concatenate([np.zeros(0, np.int64), *[s[s > 1] for _, s in self.classes]])
        reach_j = np.cumsum(np.bincount(sizes, minlength=2)[::-1])[::-1][2:]
        j = np.arange(1, len(reach_j) + 1)
        stays = rng.binomial(reach_j, (1 - discount) / (j - discount)).sum() if len(j) else 0
        opens = reach.sum() - from_strength
        if len(self.many):
            large, width = seatings.log_likelihood(self.customers[self.many], self.tables[self.many], discount), 4 / np.sqrt(1 + tables.sum())
            discount = seatings.sliced(rng, lambda d: opens * np.log(d) + stays * np.log(1 - d) + large(d), discount, float(np.clip(width, 0.01, 0.2)), 0.01, 0.99)
        else:
            discount = float(np.clip(rng.beta(1 + opens, 1 + stays), 0.01, 0.99))
        return discount, float(max(1e-3, rng.gamma(1 + from_strength, 1 / (1 - log_x))))


def first_discount(counts: np.ndarray) -> float:
    """The usual estimate from how many counts are 1 and 2."""
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(one / max(1, one + 2 * two), 0.05, 0.95))


class Part:
    """The restaurants of one part: their pairs, counts and, for each chunk, which documents hold a pair how often."""

    def __init__(self, blobs: list[dict]):
        fields = [[unpacked(b) for b in blob["pairs"]] for blob in blobs]
        self.contexts, context = compacted(np.concatenate([f[0] for f in fields]))
        context = np.repeat(context, np.concatenate([f[1] for f in fields]))
        self.words, word = compacted(np.concatenate([f[2] for f in fields]))
        key, self.pair = np.unique(context * len(self.words) + word, return_inverse=True)
        self.context, self.word = key // len(self.words), key % len(self.words)
        self.count = np.bincount(self.pair, np.concatenate([f[3] for f in fields])).astype(np.int64)
        self.known = self.count > 0
        self.here = np.bincount(self.context, self.count, len(self.contexts)).astype(np.int64)
        self.size = self.here.copy()
        self.whole = np.ones(len(self.contexts), bool)
        for f in fields:
            hot = np.searchsorted(self.contexts, f[7])
            self.size[hot], self.whole[hot] = f[8], False
        self.held = [(blob["chunk"], f[4], f[5], f[6]) for blob, f in zip(blobs, fields, strict=True)]  # documents a pair, their ordinals, times
        self.elsewhere = np.zeros(len(self.contexts))

    def seated(self) -> Tables:
        return Tables(self.count[self.known], self.context[self.known], len(self.contexts))

    def told(self, tables: Tables, part: int, ranges: int) -> list[dict]:
        """Messages to the owners: tables of each word, and of the contexts that other parts share."""
        sums = np.bincount(self.word[self.known], tables.tables, len(self.words)).astype(np.int64)
        shared = np.flatnonzero(~self.whole)
        rows = []
        for r in range(ranges):
            own, hot = self.words % ranges == r, shared[self.contexts[shared] % ranges == r]
            if own.any() or len(hot):
                payload = [packed(np.diff(self.words[own] // ranges, prepend=0)), packed(sums[own]), packed(self.contexts[hot]), packed(tables.total[hot])]
                rows.append({"r": r, "p": part, "payload": payload})
        return rows

    def root(self, messages: list[dict], ranges: int, distinct: int, tables: Tables) -> np.ndarray:
        """The root's probability of each word of the part, from what the owners told; also takes the tables that other parts hold."""
        customers, over = np.zeros(len(self.words)), np.zeros(len(self.words))
        every = sum(m["customers"] for m in messages)
        spare = 1.0 + sum(m["discount"] * m["tables"] for m in messages)
        for m in messages:
            counts, seats, hot, total = (unpacked(b) for b in m["payload"])
            if len(counts):
                own = self.words % ranges == m["r"]
                customers[own], over[own] = counts, counts - m["discount"] * seats
            at = np.searchsorted(self.contexts, hot)
            self.elsewhere[at] = total - tables.total[at]
        return (over + spare / (distinct + 1)) / (1.0 + every)

    def sampled(self, rng: np.random.Generator, parent: np.ndarray, tables: Tables, discount: float, strength: float, sweeps: int) -> tuple[float, float]:
        above = parent[self.word[self.known]]
        for _ in range(sweeps):
            tables.sweep(rng, discount, strength, above, self.elsewhere)
            discount, strength = tables.drawn(rng, discount, strength, self.here, self.here > 0)
        return discount, strength

    def predicted(self, parent: np.ndarray, tables: Tables, discount: float, strength: float) -> np.ndarray:
        """The probability of each pair given the seating."""
        over = np.zeros(len(self.word))
        over[self.known] = self.count[self.known] - discount * tables.tables
        held = tables.total + np.where(self.whole, 0, self.elsewhere)
        size = self.size[self.context]
        found = (over + (strength + discount * held[self.context]) * parent[self.word]) / (strength + size)
        return np.where(size > 0, found, parent[self.word])


def _root_reply(messages: list[dict], distinct: int, parts: int, round_: int) -> list[dict]:
    """An owner's answer to the parts: the customers and tables of their words, and the tables of shared contexts."""
    r = messages[0]["r"]
    messages = sorted(messages, key=lambda m: m["p"])
    asked = [[unpacked(b) for b in m["payload"]] for m in messages]
    numbers = [np.cumsum(a[0]) for a in asked]
    every, at = np.unique(np.concatenate(numbers), return_inverse=True)
    customers = np.bincount(at, np.concatenate([a[1] for a in asked]), len(every)).astype(np.int64)
    hot, hot_at = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
    hot_total = np.bincount(hot_at, np.concatenate([a[3] for a in asked]), len(hot)).astype(np.int64)
    known = customers > 0
    discount = first_discount(customers)
    tables = Tables(customers[known], np.zeros(known.sum(), np.int64), 1)
    rng = np.random.default_rng([r, round_, 1])
    elsewhere = np.array([float(max(0, distinct - known.sum()))])  # every word has a table at least
    for _ in range(SWEEPS):
        tables.sweep(rng, discount, 1.0, np.full(int(known.sum()), 1 / (distinct + 1)), elsewhere)
    seats = np.zeros(len(every), np.int64)
    seats[known] = tables.tables
    totals = {"customers": float(customers.sum()), "tables": float(seats.sum()), "discount": discount}
    rows = []
    for m, own, a in zip(messages, numbers, asked, strict=True):
        i, h = np.searchsorted(every, own), np.searchsorted(hot, a[2])
        rows.append({"p": m["p"], "r": r, "payload": [packed(customers[i]), packed(seats[i]), packed(a[2]), packed(hot_total[h])], **totals})
    told = {m["p"] for m in messages}
    empty = [packed(np.zeros(0, np.int64))] * 4
    rows += [{"p": p, "r": r, "payload": empty, **totals} for p in range(parts) if p not in told]
    return rows


# ---- chunks, words and pairs ----


def _tokens(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_LOWER).split()


def _chunked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """(chunk, ids, learned, lengths, words, n, stream) of about limit tokens each, from (task, id, learned, text)."""
    ids: list = []
    learned: list[bool] = []
    lengths: list[int] = []
    index = Numbers({END: 0})
    stream: list[int] = []
    task, made, kind = 0, 0, None

    def flushed() -> pa.RecordBatch:
        nonlocal made
        flow = np.array(stream, np.int64)
        n = np.bincount(flow, np.repeat(learned, lengths), len(index)).astype(np.int64)
        row = [[(task << 33) + made], [ids], [learned], [lengths], [list(index)], [packed(n)], [packed(flow)]]
        types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary(), pa.binary()]
        made += 1
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["chunk", "ids", "learned", "lengths", "words", "n", "stream"])

    for batch in batches:
        kind = batch.schema.field(1).type
        for task, ident, learn, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tokens = _tokens(data)
            if stream and len(stream) + len(tokens) >= limit:
                yield flushed()
                ids, learned, lengths, index, stream = [], [], [], Numbers({END: 0}), []
            stream.extend(map(index.__getitem__, tokens))
            stream.append(0)
            ids.append(ident)
            learned.append(learn)
            lengths.append(len(tokens) + 1)
    if stream:
        yield flushed()


def _to_owners(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, words, n in zip(*(batch.column(i) for i in range(3)), strict=True):
            words, n = words.values, unpacked(n.as_py())
            to = np.array(list(map(zlib.crc32, words.to_pylist())), np.int64) % ranges
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(ranges + 1))
            r = np.flatnonzero(np.diff(ends))
            parts = [order[ends[x] : ends[x + 1]] for x in r]
            lists = pa.ListArray.from_arrays(pa.array([0, *ends[r + 1]], pa.int32()), words.take(pa.array(order)))
            columns = pa.array(r, pa.int32()), pa.array([chunk.as_py()] * len(r), pa.int64()), pa.array([packed(np.diff(o, prepend=0)) for o in parts], pa.binary()), lists, pa.array([packed(n[o]) for o in parts], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns), ["r", "chunk", "at", "words", "n"])


def _counted(table: pa.Table, ranges: int) -> pa.Table:
    """An owner's words with their counts and numbers, told back to each chunk in its order."""
    table = table.sort_by("chunk").combine_chunks()
    words = table["words"].combine_chunks()
    coded = words.flatten().dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    n = np.bincount(at, np.concatenate([unpacked(b) for b in table["n"].to_pylist()]), len(coded.dictionary)).astype(np.int64)
    order = pc.sort_indices(pa.table({"n": n, "w": coded.dictionary}), [("n", "descending"), ("w", "ascending")]).to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])
    own = [at[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    first = np.arange(len(own)) == 0
    return pa.table({
        "chunk": table["chunk"], "r": table["r"], "at": table["at"], "numbers": pa.array([packed(number[o]) for o in own], pa.binary()), "counts": pa.array([packed(n[o]) for o in own], pa.binary()),
        "distinct": pa.array(first * (n > 0).sum(), pa.int64()), "tokens": pa.array(first * n.sum(), pa.int64()),
    })


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _sent(batches: Iterator[pa.RecordBatch], ranges: int, parts: int, distinct: int, tokens: int, hot: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's pairs for every part, and its own row for part chunk modulo parts: (p, chunk, pairs, own)."""
    for batch in batches:
        own_type = pa.list_(pa.struct([("doc_id", batch.schema.field(1).type.value_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64())]))
        for row in batch.to_pylist():
            flow, lengths, learned = unpacked(row["stream"]), np.array(row["lengths"]), np.array(row["learned"], bool)
            size = int(flow.max()) + 1
            number, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for part in row["told"]:
                at = np.cumsum(unpacked(part["at"]))
                number[at], count[at] = unpacked(part["numbers"]) * ranges + part["r"], unpacked(part["counts"])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            base = np.log10((count + ADDED) / (tokens + ADDED * (distinct + 1)))
            columns = row["ids"], ~learned, lengths, np.add.reduceat(count[flow] > 0, starts, dtype=np.int64), np.add.reduceat(base[flow], starts)
            own = [{"doc_id": d, "held_out": bool(h), "n_tokens": int(n), "n_known": int(k), "base_score": float(b)} for d, h, n, k, b in zip(*columns, strict=True)]
            order = np.argsort(number)
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            # pairs in the order of their numbers, with the documents of each
            docs = len(lengths)
            key, times = np.unique((rank[np.roll(flow, 1)] * size + rank[flow]) * docs + runs(lengths), return_counts=True)
            doc, pair = key % docs, key // docs
            begins = np.flatnonzero(np.diff(pair, prepend=-1))
            holders = np.diff(begins, append=len(pair))
            context, word = order[pair[begins] // size], order[pair[begins] % size]
            seen = np.add.reduceat(times * learned[doc], begins)
            slices = -(-count[context] // hot)
            slot = np.where(slices > 1, _mixed(number[word]) % np.maximum(slices, 1).astype(np.uint64), 0)
            to = (_mixed(number[context] + slot.astype(np.int64) * 0x51ED27) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[by], np.arange(parts + 1))
            posting_of = np.concatenate([[0], np.cumsum(holders)])
            found = []
            for p in np.flatnonzero(np.diff(ends)):
                mine = by[ends[p] : ends[p + 1]]
                posted = np.repeat(posting_of[mine], holders[mine]) + np.arange(holders[mine].sum()) - np.repeat(np.cumsum(holders[mine]) - holders[mine], holders[mine])
                edges = np.flatnonzero(np.diff(context[mine], prepend=-1))
                heads = context[mine][edges]
                split = heads[count[heads] > hot]
                arrays = number[heads], np.diff(edges, append=len(mine)), number[word[mine]], seen[mine], holders[mine], doc[posted], times[posted], number[split], count[split]
                found.append((int(p), row["chunk"], [packed(a) for a in arrays], None))
            found.append((row["chunk"] % parts, row["chunk"], None, own))
            types = pa.int32(), pa.int64(), pa.list_(pa.binary()), own_type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["p", "chunk", "pairs", "own"])


_MESSAGE = "r int, p int, payload array<binary>"
_REPLY = "p int, r int, payload array<binary>, customers double, tables double, discount double"


def _rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: r.get("chunk", r.get("r")))


def log_probabilities(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, chunk: int = CHUNK, part: int = PART, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text; rows where learn is true are learned from."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("task"), F.col(id_col).alias("id"), learn.alias("learned"), F.col(text_col).cast("binary").alias("text"))
    schema = f"chunk long, ids array<{kind}>, learned array<boolean>, lengths array<int>, words array<binary>, n binary, stream binary"
    chunks = stash(rows.mapInArrow(lambda it: _chunked(it, chunk), schema), "chunks")
    size = chunks.select(F.sum(F.size("words")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    ranges, parts = (max(1, -(-(n or 0) // each)) for n, each in zip(size, (words, part), strict=True))

    sent = chunks.select("chunk", "words", "n").mapInArrow(lambda it: _to_owners(it, ranges), "r int, chunk long, at binary, words array<binary>, n binary")
    told = stash(sent.groupBy("r").applyInArrow(lambda t: _counted(t, ranges), "chunk long, r int, at binary, numbers binary, counts binary, distinct long, tokens long"), "numbers")
    distinct, tokens = (n or 0 for n in told.select(F.sum("distinct"), F.sum("tokens")).first())

    by_chunk = told.groupBy("chunk").agg(F.collect_list(F.struct("r", "at", "numbers", "counts")).alias("told"))
    known = chunks.select("chunk", "ids", "learned", "lengths", "stream").join(by_chunk, "chunk")
    own_type = f"array<struct<doc_id:{kind},held_out:boolean,n_tokens:long,n_known:long,base_score:double>>"
    pairs = known.mapInArrow(lambda it: _sent(it, ranges, parts, distinct, tokens, hot), f"p int, chunk long, pairs array<binary>, own {own_type}")

    def blobs(table: pa.Table) -> list[dict]:
        return [r for r in _rows(table) if r["pairs"]]

    def opened(table: pa.Table) -> pa.Table:
        """The first messages: one table for each pair."""
        found = []
        if own := blobs(table):
            restaurants = Part(own)
            found = restaurants.told(restaurants.seated(), table["p"][0].as_py(), ranges)
        return pa.Table.from_pylist(found, pa.schema([("r", pa.int32()), ("p", pa.int32()), ("payload", pa.list_(pa.binary()))]))

    def prepared(own: list[dict], replies: list[dict], seed: list[int], sweeps: int) -> tuple:
        restaurants, rng = Part(own), np.random.default_rng(seed)
        tables = restaurants.seated()
        parent = restaurants.root(replies, ranges, distinct, tables)
        first = first_discount(restaurants.count[restaurants.known])
        return restaurants, rng, tables, parent, *restaurants.sampled(rng, parent, tables, first, 1.0, sweeps)

    def seated(left: pa.Table, right: pa.Table) -> pa.Table:
        """The messages after some sweeps."""
        found = []
        if left.num_rows and (own := blobs(left)):
            p = left["p"][0].as_py()
            restaurants, _, tables, *_ = prepared(own, _rows(right), [p, 2], SWEEPS)
            found = restaurants.told(tables, p, ranges)
        return pa.Table.from_pylist(found, pa.schema([("r", pa.int32()), ("p", pa.int32()), ("payload", pa.list_(pa.binary()))]))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        """(chunk, sums, own): each chunk's documents' log probabilities by this part's pairs, and chunks' own rows as they came."""
        found = [{"chunk": r["chunk"], "sums": None, "own": r["own"]} for r in left.to_pylist() if r["own"]]
        if own := blobs(left) if left.num_rows else []:
            restaurants, rng, tables, parent, discount, strength = prepared(own, _rows(right), [left["p"][0].as_py(), 3], BURN_IN)
            mean = np.zeros(len(restaurants.word))
            for _ in range(SAMPLES):
                discount, strength = restaurants.sampled(rng, parent, tables, discount, strength, 1)
                mean += restaurants.predicted(parent, tables, discount, strength) / SAMPLES
            log, at = np.log10(mean), 0
            for number, holders, doc, times in restaurants.held:
                pair = restaurants.pair[at : at + len(holders)]
                at += len(holders)
                sums = np.bincount(doc, np.repeat(log[pair], holders) * times)
                found.append({"chunk": number, "sums": zstandard.ZstdCompressor(level=1).compress(sums.tobytes()), "own": None})
        fields = [("chunk", pa.int64()), ("sums", pa.binary()), ("own", left.schema.field("own").type if left.num_rows else pa.null())]
        return pa.Table.from_pylist(found, pa.schema(fields))

    def answer(round_: int) -> Callable[[pa.Table], pa.Table]:
        fields = [("p", pa.int32()), ("r", pa.int32()), ("payload", pa.list_(pa.binary())), *[(n, pa.float64()) for n in ("customers", "tables", "discount")]]
        return lambda table: pa.Table.from_pylist(_root_reply(table.to_pylist(), distinct, parts, round_), pa.schema(fields))

    messages = pairs.groupBy("p").applyInArrow(opened, _MESSAGE)
    for i in range(rounds):
        replies = messages.groupBy("r").applyInArrow(answer(i), _REPLY)
        both = pairs.groupBy("p").cogroup(replies.groupBy("p"))
        messages = both.applyInArrow(seated, _MESSAGE) if i + 1 < rounds else both.applyInArrow(scored, f"chunk long, sums binary, own {own_type}")

    def finished(table: pa.Table) -> pa.Table:
        """The rows of one chunk's documents."""
        own = next(r for r in table["own"].to_pylist() if r)
        score = np.zeros(len(own))
        for data in sorted(b for b in table["sums"].to_pylist() if b):
            sums = np.frombuffer(zstandard.ZstdDecompressor().decompress(data))
            score[: len(sums)] += sums
        found = pa.Table.from_pylist(own, pa.schema([*table["own"].type.value_type]))
        return found.append_column("train_tokens", pa.array([tokens] * len(own), pa.int64())).append_column("score", pa.array(score))

    final = messages.groupBy("chunk").applyInArrow(finished, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, train_tokens long, score double")
    return final.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are not learned from: 10 divides the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0, F.lit(False))
