import random

import numpy as np
import pytest

from wavegrid.llm import near_dedup as nd
from wavegrid.llm.components import UnionFind, components


def sets(rows, k):
    return [nd.shingle_set(nd.normal((t or "").encode()), k) for _, t in rows]


def brute(rows, k, percent):
    found, s = UnionFind(), sets(rows, k)
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                found.union(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(found.find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(ids) if ids else None
        out += [(str(rows[i][0]), len(s[i]), str(least), rows[i][0] == least) for i in members]
    return sorted(out)


def run(df, k, percent=80):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in nd.near_duplicates(df, k=k, percent=percent).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(5, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("k", [1, 2, 5])
def test_equals_brute_force(docs, k):
    rows = corpus(k)
    assert run(docs(rows, 5), k) == brute(rows, k, 80)


def test_every_link_of_a_large_band_counts(docs, monkeypatch):
    """With one band and one value the texts meet in few bands, so pivots alone
    would miss links; blocks are small."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(40), rng.choice([2, 3, 4])):
            w[at] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(nd, "BLOCK", 7)
    assert run(docs(rows, 4), 1) == brute(rows, 1, 80)


def near_copies(seed, n, words=100, least=3, most=5):
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(least, most)):
            w[at] = f"x{rng.randrange(200)}"
        rows.append((i, " ".join(w)))
    return rows


def test_a_large_group_passes_on_few_links(docs, monkeypatch):
    """2,000 near copies, most of which are linked with few others: what the tiles
    pass on stays below one link for each row that they are given, and all links
    of pairs that share a band count."""
    rows, tables, made = near_copies(7, 2000), {}, nd.materialize

    def kept(df, name):
        tables[name] = made(df, name)
        return tables[name]

    monkeypatch.setattr(nd, "materialize", kept)
    monkeypatch.setattr(nd, "BLOCK", 300)
    got = run(docs(rows, 4), 2)
    assert got == brute(rows, 2, 80)
    assert tables["more-links"].count() < tables["open-members"].count() / 8
    assert tables["more-links"].count() < len(rows)


def test_tiles_equal_brute_force(monkeypatch):
    rows = near_copies(3, 150, 60) + [(200 + i, t) for i, t in corpus(5, 60) if t]
    words = [nd.normal(t.encode()) for _, t in rows]
    for dense, cells in ((2, 1 << 20), (16, 1 << 20), (2, 300), (1000, 0)):
        monkeypatch.setattr(nd, "DENSE", dense)
        monkeypatch.setattr(nd, "CELLS", cells)
        tile = nd._Tile(0, 2, 80)
        for i, w in enumerate(words):
            tile.add(b"%d" % i, b"%d" % i, w)
        joined = UnionFind()
        for a, b in tile.links([b"%d" % i for i in range(len(words))], [b"%d" % i for i in range(len(words))], words):
            joined.union(int(a), int(b))
        want = UnionFind()
        for i in range(len(words)):
            for j in range(i):
                if nd.similar(words[i], words[j], 2, 80):
                    want.union(i, j)
        assert {joined.find(i) for i in range(len(words))} == {want.find(i) for i in range(len(words))}
        assert all(joined.find(i) == want.find(i) for i in range(len(words)))


def test_odd_rows(docs, odd_rows):
    rows = odd_rows + [(20, "ONE Two three"), (None, "word " * 3000), (21, "alpha")]
    assert run(docs(rows, 3), 2) == brute(rows, 2, 80)
    assert run(docs([]), 2) == []


def sequential(elements, size):
    """The algorithm as published, one element at a time."""
    h = np.full(size, np.inf)
    with np.errstate(over="ignore"):
        for e in elements:
            p = list(range(size))
            for j in range(size):
                one = np.array([e], np.uint64)
                r = float(nd.mix(one + np.uint64((j + 1) * int(nd._G1) % 2**64))[0] >> np.uint64(11)) * 2.0**-53
                k = int(nd.mix(one ^ np.uint64((j + 1) * int(nd._G2) % 2**64))[0] % np.uint64(size - j)) + j
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(h[p[j]], r + j)
    return h


def test_signatures_equal_the_sequential_algorithm():
    rng = np.random.default_rng(0)
    counts = [1, 2, 7, 40, 200]
    docs_ = np.repeat(np.arange(len(counts)), counts)
    elements = rng.integers(0, 2**63, len(docs_)).astype(np.uint64)
    got = nd.super_minhash(docs_, elements, len(counts) + 1, 24)
    for i in range(len(counts)):
        assert np.array_equal(got[i], sequential(elements[docs_ == i], 24))
    assert np.isinf(got[-1]).all()


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (160, 20, 20))
    x, y = np.concatenate([shared, a]), np.concatenate([shared, b])
    s = nd.super_minhash(np.repeat([0, 1], [180, 180]), np.concatenate([x, y]), 2, 2048)
    assert (s[0] == s[1]).mean() == pytest.approx(0.8, abs=0.04)


def test_shingles_do_not_depend_on_neighbours():
    texts = [b"a b c", b"", b"  ", b"a b", b"x", b"a b c a b c", b"Tail "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    d, v = nd.shingles(data, offsets, 3)
    for i, t in enumerate(texts):
        _, own = nd.shingles(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 3)
        assert np.array_equal(v[d == i], own) and len(own) == len(nd.shingle_set(nd.normal(t), 3))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + i, 501 + i) for i in range(60)] + [(700, i) for i in range(701, 800)]
    links = [(a, b) for a, b in links if a != b]
    want = UnionFind()
    for a, b in links:
        want.union(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(6)).collect()}
    assert got == {x: want.find(x) for x in want.parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_keep_first(docs, odd_rows):
    rows = corpus(3) + odd_rows
    df = docs(rows, 3)
    kept = nd.keep_first(df, k=5)
    assert kept.columns == df.columns
    want = sorted({(i, t) for (i, t), (_, _, _, k) in zip(rows, [next(x for x in brute(rows, 5, 80) if x[0] == str(i)) for i, _ in rows]) if k and i is not None and i > 20})
    got = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None and r.doc_id > 20)
    assert got == want
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids))
