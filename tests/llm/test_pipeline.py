import pandas as pd
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from wavegrid.llm import near_dedup  # noqa: E402
from wavegrid.llm.common import materialize  # noqa: E402
from tests.llm import test_decontaminate, test_secret_scan, test_sentencepieces  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against its brute-force version on its own input."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(materialize(stage(spark, steps[-1], DATA), "test-stage"))
    frames = [s.toPandas() for s in steps]
    assert all(s.columns == columns for s in steps[:-1])

    good, labels = frames[1], pd.read_parquet(f"{DATA}/labels.parquet")
    verdict = labels.assign(kept=labels.doc_id.isin(good.doc_id))
    assert ((verdict.quality == 1) == verdict.kept).mean() > 0.95

    sets = {i: near_dedup.shingle_set(near_dedup.normal(t.encode()), 5) for i, t in zip(good.doc_id, good.text)}
    stays = set()
    from wavegrid.llm.components import UnionFind

    found = UnionFind()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                found.union(a, b)
    stays = {i for i in ids if found.find(i) == i}
    assert set(frames[2].doc_id) == stays and len(frames[2]) == len(stays)

    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    rows = list(zip(frames[2].doc_id, frames[2].text))
    hit = {int(i) for i, _, n, _, _ in test_decontaminate.brute(rows, list(zip(items.item_id, items.text)), 8) if n}
    assert set(frames[3].doc_id) == set(frames[2].doc_id) - hit

    before, after = frames[3].set_index("doc_id"), frames[4].set_index("doc_id")
    assert set(before.index) == set(after.index)
    for i, text in before.text.items():
        if not test_secret_scan.brute(text):
            assert after.text[i] == text
        else:
            assert "[SECRET]" in after.text[i] and not test_secret_scan.brute(after.text[i])
        assert after.n_chars[i] == len(after.text[i])

    last = frames[5].set_index("doc_id")
    v = test_sentencepieces.vocab()
    assert set(last.index) == set(after.index)
    for i in list(last.index)[:20]:
        assert list(last.ids[i]) == test_sentencepieces.ids_of(v, after.text[i]) and last.n_pieces[i] == len(last.ids[i])


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "ids", "n_pieces"] and got.count() > 0


def test_empty_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "test-empty")
        assert docs.count() == 0


def test_odd_rows(spark, docs, odd_rows):
    """Null ids and texts, empty, repeated, long and equal rows, and columns whose
    names the stages use themselves, go through all stages."""
    known = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = odd_rows + [(r[0] + 1000, r[1]) for r in known] + [(2000, known[0][1]), (2000, known[0][1]), (None, known[1][1]), (None, known[2][1] + " more")]
    table = docs(rows, 5)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, materialize(stage(spark, table, DATA), "test-odd")
        counts.append(table.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert table.schema == before.schema, name
            given = {(r.doc_id, r.n_words, r.term) for r in before.select("doc_id", "n_words", "term").collect()}
            assert {(r.doc_id, r.n_words, r.term) for r in table.select("doc_id", "n_words", "term").collect()} <= given
        if name == "MinHash near-dedup":
            ids = [r.doc_id for r in table.select("doc_id").collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids))
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and table.columns == ["doc_id", "ids", "n_pieces"]


def test_run_drops_what_it_no_longer_needs(spark):
    from wavegrid.llm import common

    first = common.tables_made()
    rows = corpus_pipeline.run(spark, DATA).collect()
    left = [path for path in common._tables[first:] if path]
    assert rows and sum("quality-classifier" in p or "near-dedup" in p or "labels" in p or "described" in p or "postings" in p for p in left) == 0
