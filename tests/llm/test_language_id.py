import math
import zlib

import numpy as np
import pandas as pd
import pytest

from wavegrid.llm import language_id
from wavegrid.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.01"


def small():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "▁ab", *(f"<0x{b:02X}>" for b in range(256))]
    p = np.random.default_rng(0).random((len(pieces), 2))
    return language_id.Model(["x", "y"], pieces, p / p.sum(axis=0))


def brute(model, text):
    """Sum over all segmentations, one by one."""
    if not text:
        return np.ones(2)
    total = np.zeros(2)
    for n in range(1, len(text) + 1):
        at = model.index.get(text[:n])
        if at is not None:
            total += model.probabilities[at] * brute(model, text[n:])
        elif n == 1:
            total += model.unknown(text[0]) * brute(model, text[n:])
    return total


@pytest.mark.parametrize("word", ["a", "ab", "abba", "aabbab", "aéb", "東"])
def test_forward_sums_all_segmentations(word):
    model = small()
    want = np.log(brute(model, "▁" + word))
    assert model.words([word])[0] == pytest.approx(want)
    assert model.word(word) == pytest.approx(want)


def test_words_of_all_lengths_agree():
    model = small()
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abé"), n)) for n in rng.integers(1, 24, 60)] + ["é" * 24]
    assert np.allclose(model.words(words), [model.word(w) for w in words])


def test_cache_overflow(monkeypatch):
    model = small()
    texts = ["".join(c) for c in (np.random.default_rng(2).choice(list("ab "), 200) for _ in range(20))]
    want = language_id.Scorer(model).texts(texts)
    monkeypatch.setattr(language_id, "CACHE", 3)
    got = language_id.Scorer(model).texts(texts)
    assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_held_out_accuracy(spark):
    got = QUERIES["op2_language_id"](spark, DATA).toPandas()
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98


def test_odd_rows(docs, odd_rows):
    train = [(i, t, lang) for i in range(40) for t, lang in (("the cat and the dog " * 3, "en"), ("le chat et le chien " * 3, "fr"))]
    model = language_id.fit(docs([*train, (None, "zzz", "zz"), (99, None, "fr"), (98, "the", None)]), vocabulary("piece_bpe_32k.model"))
    assert model.languages == ["en", "fr"]
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.predict(docs([*odd_rows, (20, "le chien"), (21, "12 34 !?")]), model).collect()}
    assert got[(20, "fr")] > 0.5
    for i in (1, 2, 3, 21):
        assert got[(i, "und")] == 0
    assert len(language_id.predict(docs(odd_rows), model).collect()) == len(odd_rows)
    assert language_id.predict(docs([]), model).collect() == []


def test_nothing_to_learn(docs):
    model = language_id.fit(docs([(1, "text", None)]), vocabulary("piece_bpe_32k.model"))
    assert [(r.lang_pred, r.score) for r in language_id.predict(docs([(1, "text")]), model).collect()] == [("und", 0.0)]


def test_ties_go_to_the_first_language():
    model = small()
    model.probabilities[:, 1] = model.probabilities[:, 0]
    lang, score = language_id.Scorer(model).texts(["ab ba"])
    assert lang == ["x"] and math.isclose(score[0], 0.5)
