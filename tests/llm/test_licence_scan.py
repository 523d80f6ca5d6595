import re
import textwrap

import duckdb
import pytest
import regex
from pyspark.sql import functions as F

from wavegrid.llm import licence_scan as ls
from wavegrid.llm.licence_texts import LICENCES, NOTICES


def changed(text):
    """The same licence in another dress."""
    text = re.sub(r"\blicense\b", "licence", text).replace("sublicense", "sub-licence").replace("copyright holder", "copyright owner")
    lines = ["Copyright (c) 2020 Some One", "  © 2021 Other", "# (C) 1999 Third", *text.upper().split("\n"), "All rights reserved."]
    return "\r\n".join(f" * {x} " for x in lines)


def typeset(text):
    """With the signs of a word processor."""
    open_ = iter("“”" * text.count('"'))
    text = "".join(next(open_) if c == '"' else c for c in text)
    return text.replace("'", "’").replace("--", "—").replace(" - ", " – ").replace("Copyright (c)", "Copyright ©").replace("  ", "\u00a0 ")


def reflowed(text):
    """In other lines, without those that a copyright line could be made of."""
    kept = [x for x in text.split("\n") if not regex.search(ls.COPYRIGHT, x.lower())]
    wraps = (textwrap.fill(" ".join(" ".join(kept).split()), width) for width in range(61, 99))
    return next(x for x in wraps if not regex.search(ls.COPYRIGHT, x.lower()))


def commented(text):
    return "/*\n" + "\n".join(f"// {x}" for x in text.split("\n")) + "\n*/\n"


def test_known_texts_in_another_dress(docs):
    rows = [(i, t) for i, (_, t) in enumerate(LICENCES)] + [(100 + i, changed(t)) for i, (_, t) in enumerate(LICENCES)]
    got = {r.doc_id: r.license_id for r in ls.scan(docs(rows)).collect()}
    for i, (name, _) in enumerate(LICENCES):
        assert got[i] == name and got[100 + i] == name


@pytest.mark.parametrize("dress", [typeset, reflowed, commented, lambda t: typeset(commented(reflowed(t)))])
def test_dresses(docs, dress):
    """Whole texts are found in other lines, comments and signs."""
    rows = [(i, dress(t)) for i, (_, t) in enumerate(LICENCES)]
    got = {r.doc_id: r.license_id for r in ls.scan(docs(rows)).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in LICENCES]


def test_common_licences_are_known():
    names = set(ls.digests(LICENCES).values())
    assert names >= {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "GFDL-1.3", "Artistic-1.0-Perl", "Zlib", "Unlicense"}


def test_neighbouring_spellings():
    assert ls.canonical_text("https https licence licence per cent per cent") == "http http license license percent percent"


def test_oracle_finds_whole_texts(spark, tmp_path):
    """The oracle has its own canonical form; whole texts are among its rows."""
    from tests.oracle import rows_of
    from wavegrid.llm.registry import ORACLES, QUERIES

    rows = [(i, d(t)) for i, (d, (_, t)) in enumerate((d, x) for x in LICENCES for d in (typeset, reflowed, commented, changed))] + [(1000, None), (1001, ""), (1002, "x\nReleased under the MIT licence\n")]
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    ours = rows_of(QUERIES["op10_licence_scan"](spark, str(tmp_path)).toPandas())
    theirs = rows_of(con.sql(ORACLES["op10_licence_scan"]).df())
    assert ours == theirs and sum(r[1] is not None for r in QUERIES["op10_licence_scan"](spark, str(tmp_path)).select("doc_id", "license_id").collect()) == len(rows) - 3


def test_other_texts_do_not_match(docs):
    mit = next(t for n, t in LICENCES if n == "MIT")
    rows = [(1, mit + "\nAlso, no warranty."), (2, mit.replace("without restriction", "with restriction")), (3, "plain"), (4, "About the MIT License.")]
    assert all(r.license_id is None and r.notices == [] for r in ls.scan(docs(rows)).collect())


def test_notices(docs):
    text = "Some text.\n  released under the MIT LICENCE!\nLicensed under the Apache License, Version 2.0.\nmore\nReleased under the MIT License."
    assert ls.scan(docs([(1, text)])).first().notices == ["Apache-2.0", "MIT", "MIT"]


def test_expression_equals_the_function(spark):
    texts = [t for _, t in LICENCES + NOTICES] + [changed(t) for _, t in LICENCES] + ["É (c) x", "", " \n ", "a\rcopyright 2020 b\rc", "sub-licence per cent HTTPS://x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ls.canonical(F.col("t")).alias("c")).collect()
    assert all(r.c == ls.canonical_text(r.t) for r in rows)


@pytest.mark.parametrize("known", [LICENCES, NOTICES, [("pd", "Public domain dedication")], [("sub", "May sublicense."), ("org", "An organization!")]])
def test_cues_lose_no_known_form(known):
    words = ls.cues(known)
    for _, text in known:
        for dressed in (text, changed(text), typeset(text), text.upper(), text.replace("organization", "organisation").replace("sublicense", "sub licence")):
            assert any(w in dressed.lower() for w in words)


def test_own_lists(docs):
    found = ls.scan(docs([(1, "PUBLIC-DOMAIN dedication"), (2, "x")]), licences=[("pd", "Public domain dedication")], notices=[("n", "Public domain, dedication")]).collect()
    assert [(r.license_id, r.notices) for r in sorted(found)] == [("pd", ["n"]), (None, [])]
    assert ls.scan(docs([(1, "--")]), licences=[("none", "...")], notices=[]).first().license_id is None


def test_ambiguous_forms_are_left_out():
    assert ls.digests([("a", "Same License"), ("b", "same license!")]) == {}


def test_odd_rows(docs, odd_rows):
    got = ls.scan(docs(odd_rows)).collect()
    assert len(got) == len(odd_rows) and all(r.license_id is None and r.notices == [] for r in got)
    assert ls.scan(docs([])).collect() == []
    own = ls.scan(docs([(1, "My License")]), licences=[("own", "my licence")], notices=[]).first()
    assert own.license_id == "own" and own.notices == []
    assert ls.scan(docs([(1, "My License")]), licences=[], notices=[]).first().license_id is None
