import hashlib

import corpus_pipeline
import __spark_entry__
from veilspan.llm import bpe, decontam, queries, secrets, simhash, toxicity


def test_registered():
    assert {q for q in __spark_entry__.queries() if q.startswith("op")} == set(queries.QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_against_their_operators(spark, sf):
    """Each stage's decisions, worked out again from the operator's own results on the stage's input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stage = {n: f for n, f in corpus_pipeline.STAGES}

    clean = simhash.written(stage["toxicity"](spark, docs, sf))
    assert clean.columns == columns
    scores = {r.doc_id: r.score for r in queries.op10_toxicity(spark, sf).collect()}
    assert ids(clean) == sorted(i for i, s in scores.items() if s < 0.5)

    single = simhash.written(stage["simhash_near_dedup"](spark, clean, sf))
    assert single.columns == columns
    groups = simhash.near_dedup(clean).collect()
    assert ids(single) == sorted({r.component_id for r in groups})

    safe = simhash.written(stage["benchmark_decontamination"](spark, single, sf))
    found = decontam.contamination(single, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert safe.columns == columns and ids(safe) == sorted(r.doc_id for r in found if not r.contaminated)

    quiet = simhash.written(stage["secret_scan"](spark, safe, sf))
    assert quiet.columns == columns and ids(quiet) == ids(safe)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (safe, quiet))
    spans = {r.doc_id: r.spans for r in secrets.scan(safe).collect()}
    for i in before:
        assert (before[i] == after[i]) == (spans[i] == "")
        assert not secrets.base_findings(after[i] or "")

    tokens = stage["byte_bpe"](spark, quiet, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in tokens} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in after.items()}
    run = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, tokens))


def test_odd_documents(spark, sf, tmp_path):
    rows = [(1, None, None, None, None), (None, "some text", "en", "s", 9), (None, None, "en", "s", 0), (2, "", "", "", 0), (2, "", "", "", 0), (3, "x" * 200000, "en", "s", 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            data = simhash.written(f(spark, data, sf))
        data.count()
    assert toxicity and bpe


def test_columns_that_clash(spark, sf):
    """Columns named like those of the stages' own tables stay as they are."""
    extra = ("toxic", "score", "label", "fp", "thash", "item_id", "base", "cands", "n", "count", "least", "key")
    rows = [(i, f"text number {i} about nothing", "en", "s", 20, *[f"{c}{i}" for c in extra]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    data = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        data = simhash.written(f(spark, data, sf))
        assert data.columns == docs.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in data.collect() for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, data, sf).count() == data.count()
