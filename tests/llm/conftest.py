import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key int, score string, label string, words string, _doc bigint, _key bigint, spans string, nth int, text_key string, kept boolean, term string"


@pytest.fixture
def docs(spark):
    """A maker of document tables whose further columns clash with names that
    the operators use."""

    def make(rows, partitions=None):
        rows = [(*r, *([None] * (5 - len(r)))) for r in rows]
        full = [(i, t, lang, source, None if t is None else len(t), "x", 1, "y", "z", "w", 1, 2, "s", 3, "t", True, "u") for i, t, lang, source, _ in rows]
        df = spark.createDataFrame(full, SCHEMA)
        return df.repartition(partitions) if partitions else df

    return make


@pytest.fixture
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, rows that share
    an id only, a long text and a long word."""
    return [
        (None, "one two three"),
        (None, None),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "one two three"),
        (4, "one two three"),
        (5, "alpha beta"),
        (5, "gamma delta"),
        (6, "word " * 3000),
        (7, "x" * 20_000),
        (8, "Ünïcödé — ▁ 東京 \U0001f600 <|endoftext|> end"),
    ]
