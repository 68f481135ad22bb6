"""The pipeline's stages on a small corpus against plain Python, and the registered queries against SQL."""

import os

import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from check import compare, connect
from fluxloom.llm.oracles import ORACLES
from fluxloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(ORACLES[name]).df()) == ""


def test_contract_has_all_queries():
    names = contract.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages_against_brute_force(spark, tmp_path):
    from test_operators import brute_components, brute_line_dedup
    head = "The first paragraph of this text has more than twenty words, so that the rules for short texts leave it alone, as they should do."
    docs = [(1, f"{head}\nOwn line number one stands here."), (2, f"{head}\nOwn line number two is a different one."), (3, f"{head}\nOwn line number one stands here!"),
            (4, "BUY!! NOW!! " * 20), (5, None), (6, head.replace("first", "second") + "\n" + " ".join(f"item{i}" for i in range(12)) + "."),
            (7, " ".join(f"item{i}" for i in range(1, 12)) + " and then a longer tail of words that nobody else has written down before today, honestly.")]
    spark.createDataFrame([(k, t, "en", "s", None) for k, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(12)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = pipeline.quality_rules(spark, rows, str(tmp_path))
    kept = {r.doc_id: r.text for r in one.collect()}
    assert sorted(kept) == [1, 2, 3, 6, 7] and one.columns == list(pipeline.COLUMNS)
    two = {r.doc_id: r.text for r in pipeline.line_dedup_stage(spark, one, str(tmp_path)).collect()}
    assert two == {k: t for k, t in brute_line_dedup(sorted(kept.items())).items() if t.strip()}
    assert 3 not in two  # all its lines stand in document 1
    three = {r.doc_id for r in pipeline.near_duplicates(spark, one, str(tmp_path)).collect()}
    assert three == {k for k, (_, c) in brute_components(sorted(kept.items())).items() if c == k}
    four = {r.doc_id: r.text for r in pipeline.decontamination(spark, one, str(tmp_path)).collect()}
    assert "item5" not in four[6] and four[7].startswith(" and then") and four[1] == kept[1]
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.lossless for r in out) and {r.doc_id for r in out} <= set(two)


def test_repeated_rows_of_one_document_stay_once(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11)] * 3 + [(None, "x", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in pipeline.near_duplicates(spark, rows, "").collect()) == ["1", "None"]
