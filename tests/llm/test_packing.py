import random
from collections import Counter, defaultdict

import pytest

from willowfold.llm import packing


def plain(lengths, sizes):
    """Best fit, one piece at a time: (final size, used) of every bin."""
    bins = []
    for length in sorted(lengths, reverse=True):
        fits = [(s - used, s, i) for i, (s, used) in enumerate(bins) if s - used >= length]
        if fits:
            i = min(fits)[2]
        else:
            bins.append([packing.opened(length, sizes), 0])
            i = len(bins) - 1
        bins[i][1] += length
    return Counter((min(s for s in sizes if s >= used), used) for _, used in bins)


@pytest.mark.parametrize("sizes", [(10, 20, 40), (16, 64), (50,), (2048, 4096, 8192, 16384)])
def test_plan_is_best_fit(sizes):
    rng = random.Random(len(sizes))
    for _ in range(40):
        lengths = [rng.randint(1, max(sizes)) if rng.random() < 0.5 else rng.randint(1, max(sizes) // 10) for _ in range(rng.randint(1, 200))]
        held, kind = defaultdict(list), {}
        for length, low, high, first, each, filled, size, used in packing.plan(Counter(lengths), sizes):
            for q in range(low, high + 1):
                place = first + (q - low) // each
                held[place].append((filled + (q - low) % each * length, length))
                assert kind.setdefault(place, (size, used)) == (size, used)
        for place, own in held.items():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at == kind[place][1] <= kind[place][0]
        assert sorted(length for own in held.values() for _, length in own) == sorted(lengths)
        assert Counter(kind.values()) == plain(lengths, sizes)


def check(docs, sizes):
    want = [(r.doc_id, len((r.text or "").encode()) + 1) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs, sizes).collect()
    by_bin, whole = defaultdict(list), Counter()
    for r in got:
        by_bin[r.bin_id].append(r)
        assert r.start == r.piece * max(sizes)
        whole[r.doc_id] += r.length
    total = Counter()
    for d, n in want:
        total[d] += n
    assert whole == total
    for own in by_bin.values():
        at = 0
        for r in sorted(own, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.length
        assert at == own[0].bin_used and own[0].bin_size == min(s for s in sizes if s >= at)
    assert sorted(by_bin) == list(range(len(by_bin)))
    assert Counter((own[0].bin_size, own[0].bin_used) for own in by_bin.values()) == plain([r.length for r in got], sizes)


def test_documents(documents):
    check(documents, packing.SIZES)
    check(documents, (100, 300))


def test_odd_rows(odd, nothing):
    check(odd, packing.SIZES)
    check(odd, (64,))
    assert packing.pack(nothing).count() == 0
