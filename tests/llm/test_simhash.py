import numpy as np
import xxhash

from willowfold.llm import simhash


def plain_fingerprint(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=4):
    """ids: {key: (id, fingerprint)}; smallest id reachable."""
    prints = list(prints)
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    fps = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius).tolist():
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(prints))]


def test_against_all_pairs(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    want = {d: (p, c) for (d, p), c in zip(prints, plain_components(prints), strict=True)}
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(documents).collect()}
    assert got == want


def test_dense_cells_are_cut_again_and_denser_parts_meet_at_midpoints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 7), replace=False).astype(np.uint64)) for _ in range(240)]
    fps = np.unique(np.array([base[i % 4] ^ f for i, f in enumerate(flips)], np.uint64))
    distinct = spark.createDataFrame([(int(np.int64(p)),) for p in fps.view(np.int64)], "fp long")
    for limit, radius in ((2, 4), (2, 3), (40, 4)):
        want = plain_components([(i, int(p)) for i, p in enumerate(fps)], radius)
        roots = {r.node % (1 << 64): r.root for r in simhash.components(simhash.links_of(distinct, radius, limit), "a", "b").collect()}
        groups = {}
        for i, p in enumerate(fps):
            groups.setdefault(roots.get(int(p), int(np.int64(p.view(np.int64)))), []).append(i)
        assert sorted(map(tuple, groups.values())) == sorted(tuple(i for i in range(len(fps)) if want[i] == w) for w in set(want))


def test_every_choice_of_blocks_keeps_four_bits_apart():
    rng = np.random.default_rng(5)
    assert [simhash.blocks_for(n, 4096) for n in (0, 10**6, 10**9, 10**10, 10**11, 10**13)] == [6, 6, 6, 7, 8, 8]
    for blocks in (6, 7, 8):
        columns = simhash.choices(blocks)
        assert max(map(len, columns)) <= 33
        for _ in range(300):
            bits = rng.choice(64, 4, replace=False)
            assert any(not np.isin(bits, c).any() for c in columns)


def test_odd_rows(spark, odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert by[8].component_id == 7
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_clumps_are_few(spark):
    rng = np.random.default_rng(11)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 3, dtype=np.uint64):
        while len(fps) % 244 != 243:
            turned = rng.choice(64, rng.integers(0, 4), replace=False)
            fps.add(int(np.bitwise_xor.reduce(np.uint64(1) << turned.astype(np.uint64), initial=centre)))
        fps.add(int(centre ^ np.uint64(1)))
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    own = plain_components(list(enumerate(fps)))
    for cell_rows in (40, 6):
        links = simhash.links_of(table, cell_rows=cell_rows)
        assert links.count() <= 20 * len(fps)
        label = {f: i for i, f in enumerate(fps)}
        parent = list(range(len(fps)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links.collect():
            a, b = (root(label[int(np.int64(v).view(np.uint64))]) for v in (r.a, r.b))
            parent[max(a, b)] = min(a, b)
        assert [root(i) for i in range(len(fps))] == list(own)
