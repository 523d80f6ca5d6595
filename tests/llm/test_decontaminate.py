import random
import re

import pytest

from wavegrid.llm import decontaminate as dc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(rows, items, size):
    tests = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            tests.setdefault(tuple(w[s : s + size]), set()).add(i)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for g, owners in tests.items():
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit.update(range(s, s + len(g)))
                    found |= {str(o) for o in owners if o is not None}
        out.append((str(i), len(w), len(hit), sorted(found), len(found) >= 2))
    return sorted(out)


def run(df, items, **settings):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"], r.contaminated) for r in dc.decontaminate(df, items, **settings).collect())


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "item_id bigint, text string, term string, n int")


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "and", "É", "東京", "x1", "Zz", "rare", "word-two", "a_b"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 5, 12])))) for i in range(8)] + [(3, "of and of"), (9, None), (None, "only here of")]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 150)))
        if rng.random() < 0.5:
            text += "! " + (rng.choice(items)[1] or "") + "?? " + text[:40]
        rows.append((i, text))
    return rows, items


@pytest.mark.parametrize("size", [1, 3, 8])
def test_equals_brute_force(docs, spark, size):
    rows, items = corpus(size)
    assert run(docs(rows, 4), items_of(spark, items), size=size) == brute(rows, items, size)


def test_without_broadcast(docs, spark, monkeypatch):
    rows, items = corpus(11)
    monkeypatch.setattr(dc, "BROADCAST", 0)
    assert run(docs(rows, 4), items_of(spark, items), size=4) == brute(rows, items, 4)


def test_odd_rows(docs, spark, odd_rows):
    items = [(1, "one TWO three"), (2, "word " * 8), (3, "x" * 20_000), (4, "1"), (5, "not there at all")]
    rows = odd_rows + [(None, "one two three"), (30, "one two three one two three")]
    assert run(docs(rows, 2), items_of(spark, items)) == brute(rows, items, 8)
    assert run(docs([]), items_of(spark, items)) == []
    assert run(docs(rows), items_of(spark, [])) == brute(rows, [], 8)


def test_proximity(docs, spark):
    items = items_of(spark, [(1, "alpha beta gamma delta")])
    rows = [(1, "gamma alpha delta beta"), (2, "alpha beta gamma delta"), (3, "alpha beta gamma"), (4, "alpha x beta x gamma x delta")]
    got = {r.doc_id: (r.n_hit, r.n_near) for r in dc.decontaminate(docs(rows), items, size=4).collect()}
    assert got[2][0] == 4 and got[1][0] == 0 and got[1][1] > 0 and got[3] == (0, 0)


def test_keep_clean(docs, spark, odd_rows):
    rows = odd_rows + [(30, "a b one two three c")]
    df = docs(rows)
    kept = dc.keep_clean(df, items_of(spark, [(1, "one two three")]))
    assert kept.columns == df.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in rows if "one two three" not in (r[1] or ""))
