"""Secret scans with a randomness test battery, in SQL expressions only.

Base rules find assignments to secret names, access key ids and long hex runs.
The battery adds runs of ``MIN_LENGTH`` or more letters, digits and ``+/_-``
whose encoding can be inferred (hex, base32, base36, base64) and that look like
random draws from its alphabet.  For the n symbols of a run:

* chi-squared test of uniform symbol counts (Wilson-Hilferty),
* runs test of the upper against the lower half of the alphabet,
* serial correlation of neighbouring symbols.

A run's structure is the first deviate and half the two others: about 1 for a
random key of any length, and the larger the longer a run of ordinary words is.

What is controlled is the share of ordinary runs among those reported.  What is
ordinary is learned from the texts themselves: each run gets up to ``DECOYS``
decoys of its own length and encoding, joined from the capitalised words around
it and its first ``DIGITS`` digits (hex: from the hex digits around it), and is
compared with their mean.  Runs of one encoding and similar length (half a power of
two; the longest count as ``LONGEST``) form a family, since longer runs betray
structure more easily.  The deviation of its decoys from their means gives each
run a p-value, the probability that an ordinary run has so little structure, and
in each family the Benjamini-Hochberg rule at ``RATE``, over all documents, names
the runs to report.  A run of fewer than ``COMPARED`` decoys, and a family of fewer
than ``LEAST`` to spare, has nothing to compare with and is not reported.
Differences are counted in ``GRAIN``-ths, so the table of a family is bounded and
its sums are exact.

Short runs of letters and digits (base32 and base36 below about 40 symbols) do not
differ enough from joined words, and are reported only where most such runs are
random.

Positions come from the pieces between matches: Spark has no function for them.
They are summed in blocks of ``BLOCK`` matches, and a run's symbols are counted in
pieces of ``PIECE``, so memory does not grow with a run by more than its bytes.

Cases: a null text counts as empty, an empty text has no span; rows are
independent but for the families' rule, so null and repeated ids and repeated
rows each give a row; ties: runs of one family with equal differences are reported
together or not at all; a table without candidates has no family, and an empty
table gives an empty one; other columns are not read.  Positions count code
points, ends are exclusive; a span is the whole match.  A run that overlaps a base
span is not reported twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavegrid.llm.common import fresh, materialize

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Shorter matches fail, so the rules for runs ask for the length at once.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_SECRET, MIN_LENGTH, RATE, GRAIN, BLOCK, PIECE = 6, 24, 0.05, 64, 256, 1 << 16

#: Decoys of a run, the least that it is compared with, the least to spare in a
#: family, digits and symbols of a decoy at most, and characters on each side that
#: decoys are made from, as a multiple of the run's.
DECOYS, COMPARED, LEAST, DIGITS, LONGEST, AROUND = 8, 2, 8, 4, 4096, 12

#: Least deviation of a family's decoys, and the largest deviate of a test.
SPREAD, MOST = 0.5, 40.0

RUN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_LENGTH

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

#: Symbols of the inferred encodings, in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

_NONE = "array<struct<start:bigint,stop:bigint,word:string>>"


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, stop, word) of all matches; word is ``group``."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    word = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    rows = F.transform(F.arrays_zip(between.alias("gap"), found.alias("whole"), word.alias("word")), lambda r: F.struct(F.length(r["gap"]).cast("long").alias("gap"), F.coalesce(F.length(r["whole"]), F.lit(0)).cast("long").alias("size"), r["word"].alias("word")))

    def block(part: Column) -> Column:
        """Spans of a block from its own start, and its total length."""
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_NONE).alias("spans"))

        def add(state: Column, r: Column) -> Column:
            begin, end = state["at"] + r["gap"], state["at"] + r["gap"] + r["size"]
            return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("stop"), r["word"].alias("word")))).alias("spans"))

        return F.aggregate(part, start, add)

    starts = F.sequence(F.lit(1), F.size(between), F.lit(BLOCK))
    blocks = F.transform(starts, lambda s: block(F.slice(rows, s, F.lit(BLOCK))))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_NONE}>").alias("spans"))

    def join(state: Column, b: Column) -> Column:
        moved = F.transform(b["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["stop"] + state["at"]).alias("stop"), s["word"].alias("word")))
        return F.struct((state["at"] + b["at"]).alias("at"), F.concat(state["spans"], F.array(moved)).alias("spans"))

    spans = F.flatten(F.aggregate(blocks, empty, join)["spans"])
    spans = F.filter(spans, lambda s: s["word"].isNotNull())
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_NONE))


def base_spans(text: Column) -> Column:
    """Array of (start, rank, stop) of the base rules' spans."""

    def of(rank: int, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop")))

    assign = F.filter(matches(text, ASSIGN, 2), lambda s: F.length(s["word"]) >= MIN_SECRET)
    return F.array_sort(F.concat(of(0, assign), of(1, matches(text, ACCESS)), of(2, matches(text, HEX))))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal Z, by a rational approximation of erfc."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    series = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    half = F.lit(0.5) * series * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(F.lit(1.0) - half)


def _encoding(word: Column) -> Column:
    digit, lower, upper = word.rlike("[0-9]"), word.rlike("[a-z]"), word.rlike("[A-Z]")
    return (
        F.when(~digit | ~(lower | upper), None)
        .when(word.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(word.rlike("^[A-Z2-7]+$"), "base32")
        .when(word.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(lower & upper, "base64")
    )


def _structure(word: Column, code: Column) -> Column:
    """The sum of the tests' deviates, in ``GRAIN``-ths."""
    zero = F.lit(0.0)
    folded = F.when(code.isin("hex", "base36"), F.lower(word)).when(code == "base64", F.translate(word, "-_", "+/")).otherwise(word)
    alphabet = F.coalesce(*(F.when(code == name, F.lit(symbols)) for name, symbols in ALPHABETS.items()))
    k = F.length(alphabet).cast("double")

    def halves(text: Column) -> Column:
        """0 for each symbol of the alphabet's lower half, 1 for one of the upper."""
        return F.coalesce(*(F.when(code == name, F.translate(text, symbols, "0" * (len(symbols) // 2) + "1" * (len(symbols) // 2))) for name, symbols in ALPHABETS.items()))

    def often(text: Column, part: Column, size: int = 1) -> Column:
        """How often a string that can't overlap itself occurs."""
        return (F.length(text) - F.length(F.replace(text, part, F.lit("")))).cast("double") / size

    def summed(p: Column) -> Column:
        """Sums of a piece's symbols, and over their pairs with the next ones."""
        v = F.transform(F.filter(F.split(p["more"], ""), lambda c: c != ""), lambda c: F.instr(p["alphabet"], c).cast("double") - 1)
        return F.struct(
            F.transform(F.filter(F.split(p["alphabet"], ""), lambda c: c != ""), lambda c: often(p["own"], c)).alias("counts"),
            (often(p["halves"], F.lit("01"), 2) + often(p["halves"], F.lit("10"), 2)).alias("turns"),
            F.transform(F.array(v), lambda x: F.aggregate(F.zip_with(F.slice(x, F.lit(2), F.lit(PIECE)), F.slice(x, F.lit(1), F.size(x) - 1), lambda y, z: y * z), zero, lambda t, y: t + y))[0].alias("lagged"),
            (F.instr(p["alphabet"], F.substring(p["own"], F.lit(1), F.lit(1))).cast("double") - 1).alias("first"),
            (F.instr(p["alphabet"], F.substring(p["own"], F.length(p["own"]), F.lit(1))).cast("double") - 1).alias("last"),
        )

    def pieces(f: Column) -> Column:
        # A value of a lambda's argument is built once, an expression each time.
        starts = F.sequence(F.lit(0), F.length(f["folded"]) - 1, F.lit(PIECE))
        cut = F.transform(starts, lambda i: F.struct(F.substring(f["folded"], i + 1, F.lit(PIECE)).alias("own"), F.substring(f["folded"], i + 1, F.lit(PIECE + 1)).alias("more"), f["alphabet"].alias("alphabet")))
        return F.transform(F.transform(cut, lambda c: F.struct(c["own"].alias("own"), c["more"].alias("more"), halves(c["more"]).alias("halves"), c["alphabet"].alias("alphabet"))), summed)

    def tested(parts: Column) -> Column:
        counts = F.aggregate(parts, F.transform(F.sequence(F.lit(1), k.cast("int")), lambda x: F.lit(0.0)), lambda a, p: F.zip_with(a, p["counts"], lambda x, y: x + y))
        sums = F.struct(F.transform(counts, lambda c, i: F.struct(c.alias("c"), i.cast("double").alias("i"))).alias("t"), parts.alias("parts"))
        return F.transform(F.array(sums), deviate)[0]

    def deviate(s: Column) -> Column:
        def total(f):
            return F.aggregate(s["t"], zero, lambda a, x: a + f(x["c"], x["i"]))

        n = total(lambda c, i: c)
        ones, sum_, power = total(lambda c, i: F.when(i >= k / 2, c).otherwise(zero)), total(lambda c, i: c * i), total(lambda c, i: c * i * i)
        turns = F.aggregate(s["parts"], zero, lambda a, p: a + p["turns"])
        lagged = F.aggregate(s["parts"], zero, lambda a, p: a + p["lagged"])
        first, last = s["parts"][0]["first"], F.element_at(s["parts"], -1)["last"]
        chi = total(lambda c, i: c * c) * k / n - n
        spread = F.lit(2.0) / (F.lit(9.0) * (k - 1))
        z_chi = (F.pow(F.greatest(chi, zero) / (k - 1), F.lit(1.0 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
        pairs = F.lit(2.0) * ones * (n - ones)
        variance = pairs * (pairs - n) / (n * n * (n - 1))
        z_runs = F.when(variance > 0, F.abs(turns - pairs / n) / F.sqrt(variance)).otherwise(F.lit(MOST))
        mean = sum_ / n
        around = power - n * mean * mean
        z_lag = F.when(around > 1e-9, F.abs((lagged - mean * (2 * sum_ - first - last) + (n - 1) * mean * mean) / around + F.lit(1.0) / n) * F.sqrt(n)).otherwise(F.lit(MOST))
        return F.rint((F.least(F.lit(MOST), z_chi) + (F.least(F.lit(MOST), z_runs) + F.least(F.lit(MOST), z_lag)) / 2) * GRAIN).cast("int")

    given = F.struct(folded.alias("folded"), alphabet.alias("alphabet"))
    return F.transform(F.transform(F.array(given), pieces), tested)[0]


def _decoys(text: Column, s: Column) -> Column:
    """Words of a run's length and encoding made from what stands around it."""
    n = F.least(F.length(s["word"]), F.lit(LONGEST))
    reach = n * AROUND
    at = F.greatest(F.lit(0), s["start"].cast("int") - reach)
    near = F.concat_ws(" ", F.substring(text, at + 1, s["start"].cast("int") - at), F.substring(text, s["stop"].cast("int") + 1, reach))
    near = F.regexp_replace(near, RUN, " ")
    words = F.transform(F.regexp_extract_all(near, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.substring(w, F.lit(2), F.length(w))))
    letters, digits = F.array_join(words, ""), F.substring(F.regexp_replace(F.substring(s["word"], F.lit(1), n), "[^0-9]", ""), F.lit(1), F.lit(DIGITS))
    letters = F.when(s["code"] == "base32", F.upper(letters)).when(s["code"] == "hex", F.regexp_replace(near, "[^0-9a-fA-F]", "")).otherwise(letters)
    made = F.struct(letters.alias("letters"), F.when(s["code"] == "hex", "").otherwise(digits).alias("digits"))

    def slices(m: Column) -> Column:
        size = n - F.length(m["digits"])
        own = F.transform(F.sequence(F.lit(0), F.lit(DECOYS - 1)), lambda i: F.substring(m["letters"], i * size + 1, size))
        return F.transform(F.filter(own, lambda x: F.length(x) == size), lambda x: F.concat(x, m["digits"]))

    return F.transform(F.array(made), slices)[0]


def battery(text: Column) -> Column:
    """Array of (start, stop, family, x, spare, spread) of the runs with an inferred
    encoding: ``x`` is the difference of a run's structure from its decoys' mean,
    over the root of 1 + 1/decoys (null without enough decoys), ``spare`` the number
    of decoys less one, and ``spread`` 840 times the sum of their squared
    differences from their mean, which is a whole number for up to eight."""
    named = F.filter(F.transform(matches(text, RUN), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["word"].alias("word"), _encoding(s["word"]).alias("code"))), lambda s: s["code"].isNotNull())

    def measured(s: Column) -> Column:
        length = F.floor(F.lit(2.0) * F.log2(F.least(F.length(s["word"]), F.lit(LONGEST)).cast("double"))).cast("int")
        family = F.coalesce(*(F.when(s["code"] == name, F.lit(100 * i)) for i, name in enumerate(ALPHABETS))) + length
        words = F.concat(F.array(s["word"]), _decoys(text, s))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), family.alias("family"), F.transform(words, lambda w: _structure(w, s["code"])).alias("u"))

    def compared(r: Column) -> Column:
        d, nought = F.size(r["u"]) - 1, F.lit(0).cast("long")
        others = F.slice(r["u"], F.lit(2), F.lit(DECOYS))
        total, squares = F.aggregate(others, nought, lambda a, u: a + u), F.aggregate(others, nought, lambda a, u: a + u.cast("long") * u)
        enough = d >= COMPARED
        x = (r["u"][0] - total / d) / F.sqrt(F.lit(1.0) + F.lit(1.0) / d)
        return F.struct(r["start"].alias("start"), r["stop"].alias("stop"), r["family"].alias("family"), F.when(enough, F.rint(x).cast("int")).alias("x"), F.when(enough, d - 1).alias("spare"), F.when(enough, 840 * squares - F.floor(F.lit(840) / d) * total * total).alias("spread"))

    return F.transform(F.transform(named, measured), compared)


def p_value(x: Column, deviation: Column) -> Column:
    """Probability that an ordinary run differs so much from its decoys."""
    return _upper_tail(-x.cast("double") / GRAIN / deviation)


def families(docs: DataFrame, *, text_col: str = "text", rate: float = RATE) -> dict[int, tuple[float, int]]:
    """For each family that reports runs, the deviation of its decoys and the
    largest difference, in ``GRAIN``-ths, that is reported.

    The driver gets one row per family, of which there are at most some twenty for
    each encoding."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.where(text.rlike(RUN)).select(F.explode(battery(text)).alias("r")).select("r.*").where("x is not null")
    counts = materialize(runs.groupBy("family", "x").agg(F.count("*").alias("n"), F.sum("spare").alias("spare"), F.sum("spread").alias("spread")), "runs")
    null = counts.groupBy("family").agg(F.sum("n").alias("every"), F.sum("spare").alias("spare"), F.sum("spread").alias("spread")).where(F.col("spare") >= LEAST)
    null = null.select("family", "every", F.greatest(F.lit(SPREAD), F.sqrt(F.col("spread").cast("double") / 840 / F.col("spare")) / GRAIN).alias("deviation"))
    below = Window.partitionBy("family").orderBy("x")
    ranked = counts.select("family", "x", F.sum("n").over(below).alias("below")).join(null, "family")
    named = ranked.where(p_value(F.col("x"), F.col("deviation")) <= F.lit(rate) * F.col("below") / F.col("every"))
    found = named.groupBy("family", "deviation").agg(F.max("x").alias("cut")).collect()
    return {r["family"]: (r["deviation"], r["cut"]) for r in found}


def random_runs(text: Column, base: Column, rules: dict[int, tuple[float, int]]) -> Column:
    """Array of (start, stop, p) of the reported runs."""
    none = "array<struct<start:bigint,stop:bigint,p:double>>"
    if not rules:
        return F.array().cast(none)
    rule = F.create_map(*(x for family, (deviation, cut) in rules.items() for x in (F.lit(family), F.struct(F.lit(deviation).alias("deviation"), F.lit(cut).alias("cut")))))

    def reported(r: Column) -> Column:
        return F.coalesce(r["x"] <= rule[r["family"]]["cut"], F.lit(False)) & ~F.exists(base, lambda b: (b["start"] < r["stop"]) & (r["start"] < b["stop"]))

    runs = F.transform(F.filter(battery(text), reported), lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"), p_value(r["x"], rule[r["family"]]["deviation"]).alias("p")))
    return F.when(text.rlike(RUN), runs).otherwise(F.array().cast(none))


def all_spans(base: Column, runs: Column) -> Column:
    """Base spans and those of the reported runs, sorted."""
    return F.array_sort(F.concat(base, F.transform(runs, lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index("random")).alias("rank"), r["stop"].alias("stop")))))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, base and spans (arrays of start, rank in ``KINDS``, stop) and random
    (array of start, stop and p-value of the battery's spans) per row.

    Two passes over the texts and no shuffle of them: one for the families'
    rule, one for the spans."""
    rules = families(docs, text_col=text_col, rate=rate)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(text).alias("base"))
    rows = rows.select("doc_id", "base", random_runs(text, F.col("base"), rules).alias("random"))
    return rows.select("doc_id", "base", all_spans(F.col("base"), F.col("random")).alias("spans"), "random")


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become
    one mark.  Where the text changes, ``length_col`` gets its new length."""
    rules = families(docs, text_col=text_col, rate=rate)
    text = F.coalesce(F.col(text_col), F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(state: Column, s: Column) -> Column:
        cut = F.concat(state["out"], F.col(text_col).substr((state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], cut).otherwise(state["out"]).alias("out"))

    def end(state: Column) -> Column:
        return F.concat(state["out"], F.col(text_col).substr((state["at"] + 1).cast("int"), F.length(F.col(text_col))))

    base, spans = fresh(docs, "base"), fresh(docs, "spans")
    found = docs.withColumn(base, base_spans(text))
    found = found.withColumn(spans, all_spans(F.col(base), random_runs(text, F.col(base), rules)))
    hidden = F.when(F.size(spans) > 0, F.aggregate(F.col(spans), start, add, end)).otherwise(F.col(text_col))
    found = found.withColumn(text_col, hidden)
    if length_col:
        size = F.length(text_col).cast(docs.schema[length_col].dataType)
        found = found.withColumn(length_col, F.when(F.size(spans) > 0, size).otherwise(F.col(length_col)))
    return found.select(docs.columns)
