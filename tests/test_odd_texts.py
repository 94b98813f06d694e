"""Queries against their SQL on texts and vectors that the driver's smallest tables don't have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusflow.plans.queries import ORACLES, QUERIES

TEXTS = ["", " ", "\n", "\n\nbody", "OCR:", "a OCR: b\nc", "a\r\nb\r", "a\r", "x  ", "x \x85", "\xa0\nx", "\x0c\nx", "\x08y", "_x0041_", "a, b\x0c,c\n\n1,2", "..\r\n.", "t" * 700, "u " * 500, None]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """Every text at each place of a page, beside plain ones and beside one another."""
    folder = tmp_path_factory.mktemp("odd")
    rows = []
    for n, text in enumerate(TEXTS):
        for kind in range(8):
            rows.append((len(rows), text, "en", "web"))
        for kind in range(8):
            rows.append((len(rows), text if kind % 2 else TEXTS[(n + kind) % len(TEXTS)], "en", "web"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    vectors = [(0, [-1e-8] * 32 + [1.0] * 32), (1, [0.0] * 64), (2, [-0.0] * 64), (3, [1e-8, -1e-8] * 32)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["full_text", "page_neighbours", "scan_docx", "vec_mean_pool", "vec_normalise", "summary_text", "bm25_stats"])
def test_equals_sql_to_the_sign_of_zero(spark, odd_tables, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{odd_tables}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(odd_tables))
    columns = sorted(df.columns)
    expected = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, expected))


def test_values_are_bound_once(spark):
    from corpusflow.functions.text import let

    assert spark.range(1).select(let(F.lit(2), lambda x: x * x)).first()[0] == 4


def test_a_summary_needs_no_neighbours(spark, odd_tables):
    assert "Exchange" not in QUERIES["summary_text"](spark, str(odd_tables))._jdf.queryExecution().executedPlan().toString()
