import random

import numpy as np
import pytest

from wavegrid.llm import substring_dedup as sd


def brute(rows, size):
    """Kept words by definition; a null id is larger than any other."""
    rank = lambda i: 1 << 62 if i is None else i
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in texts:
        for s in range(len(w) - size + 1):
            g = tuple(w[s : s + size])
            first[g] = min(first.get(g, (rank(i), s)), (rank(i), s))
    out = []
    for i, w in texts:
        gone = set()
        for s in range(len(w) - size + 1):
            if (rank(i), s) > first[tuple(w[s : s + size])]:
                gone.update(range(s, s + size))
        out.append((str(i), len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def run(df, size):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df, size=size).collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)]
    passage = [rng.choice(words) for _ in range(25)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at = rng.randint(0, len(w))
            w[at:at] = passage[rng.randint(0, 5) :]
        if i % 7 == 0:
            w += ["again"] * 30
        rows.append((rng.randint(0, n), "  ".join(w)))
    return rows


@pytest.mark.parametrize("size", [1, 3, 20])
def test_equals_brute_force(docs, size):
    rows = corpus(size)
    assert run(docs(rows, 5), size) == brute(rows, size)


def test_hot_minimisers(docs, monkeypatch):
    rows = corpus(9, 120)
    monkeypatch.setattr(sd, "SAMPLE", 1)
    monkeypatch.setattr(sd, "HOT", 2)
    df = docs(rows, 5)
    from wavegrid.llm.common import text_key
    from pyspark.sql import functions as F

    assert len(sd.hot_minimisers(df.select("doc_id", text_key(F.col("text")).alias("text_key"), "text"), 8)) > 5
    assert run(df, 8) == brute(rows, 8)


def test_odd_rows(docs, odd_rows):
    rows = odd_rows + [(None, "word " * 25), (9, "word " * 21)]
    assert run(docs(rows, 3), 20) == brute(rows, 20)
    assert run(docs([]), 20) == []


def test_hash_collisions_are_told_apart():
    raw = b"a b\nc d\na b\n"
    begin, stop = np.array([0, 4, 8]), np.array([3, 7, 11])
    got = sd._repeats(raw, begin, stop, np.zeros(3, np.uint64), np.array([1, 2, 3]), np.zeros(3, np.int64))
    assert got.tolist() == [False, False, True]


def test_merged():
    got = sd.merged(*(np.array(x) for x in ([1, 1, 2, 1, 1], [0, 0, 0, 0, 5], [10, 0, 0, 3, 0], [5, 4, 2, 3, 1])))
    assert sorted(zip(*(x.tolist() for x in got))) == [(1, 0, 0, 6), (1, 0, 10, 5), (1, 5, 0, 1), (2, 0, 0, 2)]


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 99, 50)
    for w in (1, 2, 3, 5, 17, 50):
        assert sd.sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(51 - w)]
    assert len(sd.sliding_min(x, 51)) == 0
