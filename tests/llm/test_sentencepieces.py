import random
import struct

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wavegrid.llm import sentencepieces as sp
from wavegrid.llm.queries import vocabulary

PATH = vocabulary("piece_bpe_32k.model")


def vocab():
    return sp.cache_of(PATH).vocabulary


def brute(v, text):
    """Largest score over all cuts, and the cut whose last pieces are longest."""
    best = [(0, [])]
    for end in range(1, len(text) + 1):
        found = None
        for n in range(min(v.longest, end), 0, -1):
            piece = text[end - n : end]
            score = v.score.get(piece, v.unknown if n == 1 else None)
            if score is not None and (found is None or best[end - n][0] + score > found[0]):
                found = (best[end - n][0] + score, [*best[end - n][1], piece])
        best.append(found)
    return best[-1]


def ids_of(v, text):
    return [i for p in brute(v, " " + text)[1] for i in v.name(p)] if text else []


TEXTS = ["the cat", "  two  blanks ", "line\n\nfeed \n x", "ÜñÏ 東京 ▁ \U0001f600", "². 12³ a.b,c", "", " ", "\n", "aaaa" * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_units_give_the_best_cut(text):
    v = vocab()
    got = np.frombuffer(sp.Cache(v).encode(text), np.int32).tolist()
    assert got == ids_of(v, text)


@pytest.mark.parametrize("chunk,span", [(7, 3), (16, 256), (50, 1), (333, 2)])
def test_chunks_equal_one_pass(docs, chunk, span, monkeypatch):
    monkeypatch.setattr(sp, "SPAN", span)
    rng = random.Random(chunk)
    alphabet = ["a", "b", "th", "e", " ", "  ", "the ", "\n", "é", "東", "1", "ing", "--", "=="]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(60, 400)))) for i in range(12)] + [(99, "aab" * 200), (98, "-" * 500), (97, " " * 300)]
    got = {r.doc_id: r.ids for r in sp.encode(docs(rows, 3), PATH, chunk=chunk).collect()}
    v = vocab()
    assert got == {i: ids_of(v, t) for i, t in rows}


def test_product_is_associative():
    rng = np.random.default_rng(0)
    m = [np.where(rng.random((5, 5)) < 0.3, sp._LOW, rng.integers(-50, 0, (5, 5))) for _ in range(7)]
    assert np.array_equal(sp.combine(sp.combine(m[0], m[1]), m[2]), sp.combine(m[0], sp.combine(m[1], m[2])))
    want, out = m[0], [m[0]]
    for x in m[1:]:
        want = sp.combine(want, x)
        out.append(want)
    assert np.array_equal(sp.product(m), out[-1])
    start = np.array([0, *[sp._LOW] * 4])
    for x, b in zip(m, out):
        start = sp.after(start, x)
        assert np.array_equal(start, b[0])


def test_round_trip(docs, odd_rows):
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(TEXTS)]
    got = sp.decode(sp.encode(docs(rows), PATH, chunk=300), PATH).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    assert all(r.decoded == r.text and (r.ids is None) == (r.text is None) for r in got)
    assert sp.encode(docs([]), PATH).collect() == []


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_any_text_comes_back(text):
    v = vocab()
    ids = np.frombuffer(sp.Cache(v).encode(text), np.int32)
    assert b"".join(v.text[i] for i in ids).decode()[1:] == text


def field(number, body):
    """A length-delimited field of the model file's format."""
    size, out = len(body), bytes([number << 3 | 2])
    while size >= 128:
        out += bytes([size & 127 | 128])
        size >>= 7
    return out + bytes([size]) + body


def unigram_file(path, pieces, byte_pieces):
    """A model file of the unigram kind with these pieces and scores: normal ones,
    behind the unknown one and those of bytes."""

    def entry(piece, score, kind):
        return field(1, field(1, piece.encode()) + b"\x15" + struct.pack("<f", score) + bytes([3 << 3, kind]))

    body = entry("<unk>", 0.0, 2) + entry("<s>", 0.0, 3) + entry("</s>", 0.0, 3)
    if byte_pieces:
        body += b"".join(entry(f"<0x{b:02X}>", 0.0, 6) for b in range(256))
    body += b"".join(entry(p, s, 1) for p, s in pieces.items())
    trainer = bytes([3 << 3, 1]) + (b"\x98\x02\x01" if byte_pieces else b"")  # unigram, byte_fallback
    normalizer = field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])  # dummy prefix, keep blanks, escape them
    path.write_bytes(body + field(2, trainer) + field(3, normalizer))
    return str(path)


def fractional(seed, borders):
    rng = random.Random(seed)
    pieces = {"▁": -3.5, **{c: -rng.uniform(3, 7) for c in "abcdehinst."}}
    for _ in range(120):
        piece = "".join(rng.choice("abcdehinst") for _ in range(rng.randint(2, 6)))
        pieces[rng.choice(["", "▁"]) + piece] = -rng.uniform(2, 12)
    pieces |= {"th": -0.4, "e": -0.4, "the": -0.9, "▁t": -1.25}
    if borders:  # pieces over a unit's border
        pieces |= {"s▁a": -1.7, "t.": -0.6, "e▁": -2.2, "▁the▁b": -1.3}
    return pieces


@pytest.mark.parametrize("borders", [False, True])
@pytest.mark.parametrize("byte_pieces", [False, True])
def test_fractional_scores_give_the_librarys_ids(docs, tmp_path, borders, byte_pieces):
    path = unigram_file(tmp_path / f"unigram-{borders}-{byte_pieces}.model", fractional(1, borders), byte_pieces)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    v = sp.cache_of(path).vocabulary
    assert v.units is (not borders)
    assert v.score["th"] == round(library.get_score(library.piece_to_id("th")) * 2**24) and v.score["the"] < 2 * v.score["th"]
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["the ", "s a", "t.", "th", "e", "b", "ist ", "  ", "é", "東京", "z", "hand "]) for _ in range(rng.randint(1, 200)))) for i in range(40)]
    rows += [(90, ""), (91, " "), (92, "zzz"), (93, "the the the"), (94, "a" * 300), (95, "zé " * 60)]
    for chunk in (1 << 14, 64, 9):
        got = {r.doc_id: r.ids for r in sp.encode(docs(rows, 3), path, chunk=chunk).collect()}
        assert got == {i: library.encode(t) for i, t in rows}, chunk
    if byte_pieces:
        back = sp.decode(sp.encode(docs(rows), path, chunk=50), path).collect()
        assert all(r.decoded == r.text for r in back)


def test_scores_are_those_of_the_model_file():
    """A brute force that reads the scores from the file."""
    library, v = sentencepiece.SentencePieceProcessor(model_file=PATH), vocab()
    for text in TEXTS[:5]:
        score = sum(library.get_score(i) for i in ids_of(v, text) if not library.is_byte(i))
        got = np.frombuffer(sp.Cache(v).encode(text), np.int32).tolist()
        assert sum(library.get_score(i) for i in got if not library.is_byte(i)) == score
        assert all(v.by_id[i] == library.get_score(i) for i in got if not library.is_byte(i))


def test_small_cache(monkeypatch):
    monkeypatch.setattr(sp, "CACHE", 2)
    v = vocab()
    assert np.frombuffer(sp.Cache(v).encode("one two one three two one"), np.int32).tolist() == ids_of(v, "one two one three two one")
