"""Queries on tokens return ids that SQL learns again, beside what must hold whatever the merges."""

from __future__ import annotations

import pytest
from oracle_check import compare

import __spark_entry__ as driver
from glyphmill.plans import inputs

TEXTS = ["ab ab abc", "", " the cat, the hat\n\n the 12 mats ", "naïve ünïcode ab", "x" * 700, "ab " * 900]


@pytest.fixture
def few_documents(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS, 1)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    # The registered vocabulary needs all tables; what is tested here are the plain ids.
    monkeypatch.setattr(inputs, "vocabulary", inputs.plain_vocabulary)
    return str(tmp_path)


@pytest.mark.parametrize(
    "name, ids",
    [
        ("token_shards", "checksum"),
        ("bpe_encode", "plain_ids_md5"),
        ("split_token_totals", "n_plain_ids"),
        ("append_eot", "n_plain_ids"),
        ("next_token_pairs", "y_md5"),
    ],
)
def test_ids_are_returned_and_equal_those_of_sql(spark, few_documents, name, ids):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{few_documents}/documents.parquet/*.parquet')")
    build = driver.queries()[name]
    assert ids in build(spark, few_documents).columns
    same, n, _, _, _, detail, _ = compare(spark, con, few_documents, name, build, driver.oracle_sql()[name])
    assert same, detail
    assert n > 0
