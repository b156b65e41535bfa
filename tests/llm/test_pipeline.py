"""Registered queries and the pipeline on the small tables."""

import pytest
from conftest import SF
from oracle_check import compare

import corpus_pipeline
from barlytics.llm import bpe, decontamination, host_quality, packing, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    _, problem = compare(spark, duck, SF, name, queries.QUERIES[name], queries.ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_result(spark, name):
    source = "pages" if name in ("op2_main_text", "op8_url_rules") else "documents"
    n = spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name == "op13_chat_format":
        n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    got = queries.QUERIES[name](spark, SF).count()
    assert got == n or name in ("op5_packing", "op9_decontamination", "op12_hard_negatives") and got > 0


def test_entry_lists_all(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = docs
    stages = dict(corpus_pipeline.STAGES)
    before = set(rows)

    def run(name):
        nonlocal kept
        kept = stages[name](spark, kept, SF)
        assert kept.columns == docs.columns
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/_test-{name}"
        kept.write.mode("overwrite").parquet(path)
        kept = spark.read.parquet(path)
        return {r["doc_id"] for r in kept.collect()}

    after = run("toxicity")
    scores = {r["doc_id"]: r["predicted"] for r in queries.op6_toxicity(spark, SF).collect()}
    assert after == {d for d in before if not scores[d]}
    before, after = after, run("quality_rules")
    good = {d for d in before if (m := host_quality.measure_text(rows[d]))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert after == good
    before, after = after, run("near_duplicates")
    assert after < before
    assert len({rows[d] for d in after}) == len(after) and {min(e for e in before if rows[e] == rows[d]) for d in after} == after
    before, after = after, run("decontamination")
    items = [decontamination.normalised(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = {d for d in before if any(decontamination.distance(x, decontamination.normalised(rows[d]))[0] <= len(x) // decontamination.PER_ERROR for x in items)}
    assert after == before - near
    pieces = stages["packing"](spark, kept, SF).collect()
    coder = bpe.encoder(queries.public_tokenizers.path(queries.BYTE_BPE))
    size = {d: len(coder.encode(rows[d])) // 2 + 1 for d in after}
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    assert total == size
    assert {p["sequence_id"] >> packing.NUMBERS for p in pieces} <= set(range(64))
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in whole.select("doc_id").distinct().collect()} == after


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Nulls, repeats and columns named like helpers come through with their values; no rows give no rows."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, "en", "s", 9), (1, words, "en", "s", 9), (2, None, None, None, None), (3, "", "en", "s", 0), (None, words + " x", "en", None, 1), (5, words.upper(), "fr", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS __toxic", "2 AS __m", "3 AS __failed", "4 AS __id", "5 AS __k1", "6 AS host")
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.filter("false"), SF)
        assert none.count() == 0, name
        if name != "packing":
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            left = out.collect()
            assert {tuple(r)[5:] for r in left} <= {(1, 2, 3, 4, 5, 6)}
            if name == "near_duplicates":
                assert sorted((r["doc_id"] or 0) for r in left) == [1, 2]
            if name == "quality_rules":
                assert sorted((r["doc_id"] or 0) for r in left) == [0, 1, 1, 5]
