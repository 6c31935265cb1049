"""The queries against their SQL, and the pipeline against its stages."""

import compare
import pytest

from graphlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = compare.connect(SF)
    df = QUERIES[name](spark, SF)
    got = compare.rows(df.columns, df.collect())
    cur = con.execute(ORACLES[name])
    assert got == compare.rows([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_every_document_has_a_row(spark, name):
    df = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
