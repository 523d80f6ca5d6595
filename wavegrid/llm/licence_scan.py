"""Licence scans by canonical digests, in SQL expressions only.

A text's canonical form is lower-cased, without copyright lines, with every run
of characters other than letters and digits (of any script) as one blank, and
with equivalent spellings made one.  The SHA-256 of the whole text's form is
joined with those of known licences, and that of each line, as a text of its own,
with those of known one-line notices.  The known texts are the published ones in
``licences/``; callers can give their own.

Most texts can't have a known form, and are not put into one: letters and digits
reach a form in lower case and in place, so a known form can only come from a text
with the words that the form has, or their other spellings.  :func:`cues` derives
from the list of known texts some words of which each known form needs one.

The table of known digests has a row for each known text, which bounds its
broadcast; texts are never shuffled.

Cases: null and empty texts match nothing; rows are independent, so null and
repeated ids and repeated rows each give a row; a text that is several licences
at once is none of them; a known text without letters and digits matches nothing;
an empty table gives an empty one; other columns are not read.  A copyright
line goes as a whole, so a text whose terms are wrapped in such a way that a
copyright sign or year begins a line has another form.
"""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavegrid.llm.licence_texts import LICENCES, NOTICES

COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n\r(©]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]*(copyright|[0-9])|©|all rights reserved)[^\n]*$"
BETWEEN = r"[^\p{L}\p{N}]+"

#: Spellings that mean the same, after punctuation has gone.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("colour", "color"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("modelled", "modeled"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("offence", "offense"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("sub licence", "sublicense"),
    ("sub licences", "sublicenses"),
    ("sub license", "sublicense"),
    ("sub licensed", "sublicensed"),
    ("sub licenses", "sublicenses"),
    ("sublicence", "sublicense"),
    ("sublicenced", "sublicensed"),
    ("sublicences", "sublicenses"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]


def canonical_text(text: str) -> str:
    """The canonical form of one text, for the table of known ones."""
    import regex

    text = regex.sub(COPYRIGHT, " ", text.lower().replace("\r", "\n"))
    text = f"  {regex.sub(BETWEEN, '  ', text)}  "
    for old, new in EQUIVALENT:
        text = text.replace(_apart(old), _apart(new))
    return " ".join(text.split())


def _apart(words: str) -> str:
    """Words with two blanks between them, so that neighbours share none, as in a
    form that spellings are replaced in."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """The same as an expression."""
    lines = F.regexp_replace(F.translate(F.lower(text), "\r", "\n"), COPYRIGHT, " ")
    form = F.concat(F.lit("  "), F.regexp_replace(lines, BETWEEN, "  "), F.lit("  "))
    for old, new in EQUIVALENT:
        form = F.replace(form, F.lit(_apart(old)), F.lit(_apart(new)))
    return F.trim(F.regexp_replace(form, " +", " "))


def _spellings(word: str) -> set[str]:
    """Strings of which a lower-cased text must have one for its form to have
    ``word``."""
    found = {word}
    for old, new in reversed(EQUIVALENT):
        if word in new.split():
            found |= _spellings(max(old.split(), key=len))
    return found


def cues(known: list[tuple[str, str]]) -> list[str]:
    """Strings of which the lower-cased text behind each known form has one: words
    that most forms have first, until each form has one."""
    forms = [set(form.split()) for _, text in known if (form := canonical_text(text))]
    found: set[str] = set()
    while forms:
        counts = Counter(w for form in forms for w in form)
        best = max(counts, key=lambda w: (counts[w], len(w), w))
        found |= _spellings(best)
        forms = [form for form in forms if best not in form]
    return sorted(found)


def _cued(text: Column, words: list[str]) -> Column:
    """Whether a text has one of the words in any case."""
    lower, found = F.lower(text), F.lit(False)
    for word in words:
        found = found | F.contains(lower, F.lit(word))
    return found


def digests(known: list[tuple[str, str]]) -> dict[str, str]:
    """Licence by digest; a form that two licences share, or that is empty, is left
    out."""
    found: dict[str, set[str]] = {}
    for name, text in known:
        if form := canonical_text(text):
            found.setdefault(hashlib.sha256(form.encode()).hexdigest(), set()).add(name)
    return {digest: names.pop() for digest, names in found.items() if len(names) == 1}


def _digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", licences: list | None = None, notices: list | None = None) -> DataFrame:
    """doc_id, license_id (of a text that is a known licence, else null) and
    notices (array, sorted, one entry for each line that is a known notice).

    ``licences`` and ``notices`` are lists of (name, text), by default those of
    ``licence_texts``."""
    licences, notices = LICENCES if licences is None else licences, NOTICES if notices is None else notices
    whole, line = digests(licences), digests(notices)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = F.create_map(*(F.lit(x) for pair in line.items() for x in pair)) if line else None
    found = F.array().cast("array<string>")
    if names is not None:
        words = cues(notices)
        cued = F.filter(F.split("text", "[\r\n]+"), lambda x: _cued(x, words))
        named = F.transform(F.transform(cued, _digest), lambda d: names[d])
        found = F.when(_cued(F.col("text"), words), F.array_sort(F.filter(named, lambda x: x.isNotNull()))).otherwise(found)
    rows = rows.select("doc_id", F.when(_cued(F.col("text"), cues(licences)), _digest(F.col("text"))).alias("digest"), found.alias("notices"))
    if not whole:
        return rows.select("doc_id", F.lit(None).cast("string").alias("license_id"), "notices")
    known = docs.sparkSession.range(1).select(F.explode(F.create_map(*(F.lit(x) for pair in whole.items() for x in pair))).alias("digest", "license_id"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "license_id", "notices")
