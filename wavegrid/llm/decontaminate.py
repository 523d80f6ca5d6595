"""Benchmark decontamination by a positional inverted index, in SQL expressions
only.

1. Test windows: ``size`` consecutive words of an item; an item of fewer words
   is one window.  Equal windows are one; which items own it is a table beside.
2. Training counts of every test term are summed, and each window's rarest term
   becomes its anchor.  A window with a term that never occurs can't occur.
3. The index has a posting for each training token that is an anchor: term,
   document, position, and the terms beside it within a window's reach, which
   stand for the neighbouring postings.  It is stored in the shared folder.
4. Windows meet their anchor's postings.  The lists of the other terms, adjusted
   by their offsets, are intersected at each posting: all at their place is an
   exact phrase, all within reach but not all in place is a proximity match.
5. A text's items are those that own the different windows found in it.

Texts are never shuffled: a text is laid out in pieces of ``PIECE`` words that
overlap by a window's reach, so a posting's neighbours are in its own row.  Test
terms and windows are written once, measured, broadcast while they take at most
``BROADCAST`` bytes and joined by a shuffle beyond that; such a join stands alone
in its stage, where adaptive execution splits a hot term or window.

Cases: null, empty and wordless texts have no words and no hits, on either side;
an item's id may be null (its windows hit words, but it isn't listed or counted);
items that share an id count once; rows that share an id are told apart by their
text, and equal rows get equal results; of terms that are equally rare the first
in order is the anchor; an empty table of documents gives an empty one, and
without items no word is hit; other columns are not read and can have any names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.common import materialize, text_key

SIZE, PIECE, BROADCAST = 8, 64, 64 << 20

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: runs of ASCII digits, ASCII letters and all other
    characters beyond ASCII, with A to Z lower-cased and nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(F.coalesce(lower, F.lit("")), _BETWEEN), "")


def windows(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = SIZE) -> tuple[DataFrame, DataFrame]:
    """(window, words) of each different window, and (window, item) of the items,
    their ids as strings, that own it.  A window is named by 128 bits of hash."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    rows = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("words"))
    rows = rows.select("item", "words", F.concat(F.hex(F.xxhash64("words")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "words"))).alias("window"))
    rows = materialize(rows, "item-windows")
    tests = materialize(rows.groupBy("window").agg(F.first("words").alias("words")), "windows")
    return tests, rows.where("item is not null").select("window", "item").distinct()


def _small(df: DataFrame, size: Column) -> DataFrame:
    """A stored table with a hint to broadcast it if its rows, of ``size`` bytes
    and some more, are few."""
    held = df.agg(F.sum(size.cast("long") + 64)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST else df


def anchored(tests: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds each window's rarest term in the training rows (``words``) and its
    offset; windows that can't occur go."""
    length = F.octet_length("term")
    terms = _small(materialize(tests.select(F.explode("words").alias("term")).distinct(), "terms"), length)
    counts = rows.select(F.explode("words").alias("term")).join(terms, "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = materialize(counts, "term-counts")
    placed = tests.select("*", F.posexplode("words").alias("offset", "term")).join(_small(counts, length), "term", "left")
    rarest = F.min_by(F.struct("term", "offset"), F.struct("n", "term", "offset"))
    found = placed.groupBy("window").agg(F.first("words").alias("words"), rarest.alias("anchor"), F.count("n").alias("known"))
    return found.where(F.col("known") == F.size("words")).select("window", "words", F.col("anchor.term").alias("term"), F.col("anchor.offset").alias("offset"))


def index(rows: DataFrame, anchors: DataFrame, size: int = SIZE) -> DataFrame:
    """Postings (term, doc_id, text_key, at, around, here) of the anchors' terms:
    ``at`` is the position in the text, ``here`` that in ``around``."""
    reach = size - 1
    starts = F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1, F.lit(PIECE))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s, F.lit(reach)).alias("lead"), F.slice("words", F.greatest(F.lit(1), s + 1 - reach), F.least(s, F.lit(reach)) + PIECE + reach).alias("part")))
    cut = rows.select("doc_id", "text_key", F.explode(pieces).alias("p")).select("doc_id", "text_key", "p.*")
    own = F.slice("part", F.col("lead") + 1, F.lit(PIECE))
    tokens = cut.select("*", F.posexplode(own).alias("i", "term"))
    terms = materialize(anchors.select("term").distinct(), "anchor-terms")
    found = tokens.join(_small(terms, F.octet_length("term")), "term")
    here = F.col("lead") + F.col("i")  # from 0, in the piece
    left = F.least(here, F.lit(reach))
    return found.select("term", "doc_id", "text_key", (F.col("start") + F.col("i")).alias("at"), left.alias("here"), F.slice("part", here - left + 1, left + size).alias("around"))


def _matches(docs: DataFrame, tests: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    anchors = materialize(anchored(tests, rows), "anchors")
    postings = materialize(index(rows, anchors, size), "postings")
    met = postings.join(_small(anchors.withColumn("n", F.size("words")), F.octet_length(F.array_join("words", " ")) * 2), "term")
    begin = F.col("here") - F.col("offset")  # of the window in the terms around
    exact = F.when(begin >= 0, F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.col("n")) == F.col("words")).otherwise(F.lit(False))
    near = F.size(F.array_except("words", "around")) == 0
    return met.where(near).select("doc_id", "text_key", (F.col("at") - F.col("offset")).alias("start"), "n", "window", exact.alias("exact"))


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, text_key, start, n, window, exact): occurrences of test windows.

    ``exact`` ones cover the words ``start`` to ``start + n``; of the others all
    terms stand within ``size`` - 1 words of the anchor.
    """
    tests, _ = windows(items, id_col=item_id, text_col=item_text, size=size)
    return _matches(docs, tests, id_col, text_col, size)


def hits(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, text_key, n_hit, items, n_near) of each text with a match: words
    inside exact windows, their items' ids (sorted strings) and the number of
    proximity matches."""
    tests, owners = windows(items, id_col=item_id, text_col=item_text, size=size)
    found = materialize(_matches(docs, tests, id_col, text_col, size).distinct(), "matches")
    owners = _small(materialize(owners, "owners"), F.octet_length("item"))
    held = found.where("exact").select("doc_id", "text_key", "window").distinct().join(owners, "window").select("doc_id", "text_key", "item").distinct()
    parts = found.select("doc_id", "text_key", F.when(F.col("exact"), F.struct("start", "n")).alias("span"), F.lit(None).cast("string").alias("item"), (~F.col("exact")).alias("near"))
    parts = parts.unionByName(held.withColumn("near", F.lit(False)), allowMissingColumns=True)
    per_text = parts.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"), F.count_if("near").alias("n_near"))
    begun = F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("sum"))

    def add(state: Column, s: Column) -> Column:
        stop = s["start"] + s["n"]
        return F.struct(F.greatest(state["reach"], stop).alias("reach"), (state["sum"] + F.greatest(F.lit(0), stop - F.greatest(state["reach"], s["start"]))).alias("sum"))

    return per_text.select("doc_id", "text_key", F.aggregate("spans", begun, add)["sum"].alias("n_hit"), "items", "n_near")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of the items with an occurring window,
    sorted strings), n_near and contaminated (``least_items`` or more) per row."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, item_id=item_id, item_text=item_text, size=size)
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "n_hit", "items", "n_near")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key")), "left")
    items_or_none = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), items_or_none.alias("items"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (F.size(items_or_none) >= least_items).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has no whole
    window of any item."""
    found = hits(docs, items, id_col=id_col, text_col=text_col, item_id=item_id, item_text=item_text, size=size).where("n_hit > 0")
    bad = found.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_doc"]) & (text_key(docs[text_col]) == bad["_key"]), "left_anti")
