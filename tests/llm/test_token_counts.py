from hypothesis import given, settings
from hypothesis import strategies as st

from wavegrid.llm import token_counts
from wavegrid.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


def brute(text, path=PATH):
    from tokenizers import Tokenizer

    return len(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library(docs, odd_rows):
    rows = odd_rows + [(9, "a  b\n\n c\t" * 500), (10, "it's 12'll  x" * 300), (11, "<|endoftext|> " * 9)]
    got = token_counts.count_tokens(docs(rows), PATH, piece_chars=50, batch_bytes=400, limit=100).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), brute(t), brute(t) > 100) for i, t in rows)


def test_other_vocabularies(docs):
    import sentencepiece

    text = "The  quick brown fox\njumps. " * 40
    path = vocabulary("word_bpe_49k.json")
    assert token_counts.count_tokens(docs([(1, text)]), path, piece_chars=30).first().n_tokens == brute(text, path)
    path = vocabulary("piece_bpe_32k.model")
    want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    assert token_counts.count_tokens(docs([(1, text)]), path, piece_chars=30).first().n_tokens == want


def test_empty_table(docs):
    assert token_counts.count_tokens(docs([]), PATH).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab1 \n\t's. 　é<|>", max_size=120), st.integers(1, 20))
def test_pieces_add_up(text, size):
    count, cut = token_counts._encoder(PATH)
    parts = list(token_counts.pieces(text, size, cut))
    assert "".join(parts) == text and sum(count(parts)) == brute(text)


def test_unsafe_tokenizers_get_whole_texts(docs, tmp_path):
    """A tokenizer that puts a blank in front, or has its own pattern, must see a
    text as a whole."""
    from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

    text = "one two three four 12ab " * 25
    changes = {
        "prefix": {"pre_tokenizer": pre_tokenizers.ByteLevel(add_prefix_space=True)},
        "pattern": {"pre_tokenizer": pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"\w+ \w+|."), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])},
        "prepend": {"normalizer": normalizers.Prepend(" ")},
        "replace": {"normalizer": normalizers.Replace(" ", "")},
    }
    for name, parts in changes.items():
        model = Tokenizer.from_file(PATH)
        for part, value in parts.items():
            setattr(model, part, value)
        path = str(tmp_path / f"{name}.json")
        model.save(path)
        assert token_counts._encoder(path)[1] is None
        assert token_counts.count_tokens(docs([(1, text)]), path, piece_chars=30).first().n_tokens == brute(text, path)
    assert token_counts._encoder(PATH)[1] is token_counts._CUTS["byte-level"]


def test_long_text_without_white_space(docs):
    """It is cut between letters and digits."""
    text = "".join(f"word{i}" for i in range(3000))
    parts = list(token_counts.pieces(text, 100))
    assert len(parts) > 100 and max(map(len, parts)) < 120
    assert token_counts.count_tokens(docs([(1, text)]), PATH, piece_chars=100).first().n_tokens == brute(text)
