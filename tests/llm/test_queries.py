"""Every registered query over the smallest tables: against its SQL where there is one, else against what its contract says of rows and columns."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.llm import _store, mixing, token_shards
from lectern.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": None,
    "op2_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_ann_forest": ["query_id", "rank", "vec_id", "score"],
    "op6_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op7_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_token_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12_source_audit": ["lang", "source", "part", "item", "value", "rank"],
    "op13_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
}


def text_of(rows):
    return sorted(map(repr, rows))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", COLUMNS)
def test_a_query_runs_over_its_table(spark, name):
    frame = llm_queries.queries()[name](spark, SF)
    got = frame.toPandas()
    if COLUMNS[name]:
        assert got.columns.tolist()[: len(COLUMNS[name])] == COLUMNS[name]
    sql = llm_queries.oracle_sql().get(name)
    if sql:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
        want = con.sql(sql).df()
        assert sorted(want.columns) == sorted(got.columns)
        key = sorted(got.columns)
        plain = lambda df: text_of(df[key].astype(object).where(df[key].notna(), None).values.tolist())
        assert plain(got) == plain(want)
    elif name == "op5_ann_forest":
        assert len(got) == 5 * spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    elif name != "op1_token_counts":
        table = "pages" if name == "op8_html_extraction" else "documents"
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ("op4_language_id", "op10_toxicity"):
        assert got["score"].between(0, 1).all()


def test_results_do_not_depend_on_what_is_broadcast(spark, monkeypatch, tmp_path):
    """Very many sources, or parts of a token file, are shuffled; the rows are the same."""
    import public_tokenizers

    docs = spark.createDataFrame([(i, "w " * (i % 13), f"host-{i % 90}" if i % 7 else None) for i in range(600)], "doc_id long, text string, source string")
    columns = ["doc_id", "source", "size", "source_size", "target", "taken"]
    run = lambda: text_of(mixing.mix(docs, slots=512)["documents"].select(*columns).collect())
    tokens = lambda: text_of(token_shards.read_tokens(token_shards.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))).collect())
    before = run(), tokens()
    for module in (mixing, token_shards):
        monkeypatch.setattr(module, "small_enough", lambda *_, **__: False)
    assert (run(), tokens()) == before


def test_tables_of_a_session_can_be_cleared(spark):
    store = _store.Scratch(spark, "clearing")
    store.write(spark.range(3).withColumn("x", F.lit(1)), "t")
    folder = _store.shared_dir(spark).removeprefix("file://")
    assert os.path.isdir(folder)
    _store.clear(spark)
    assert not os.path.exists(folder)
