"""The registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

pytest.importorskip("livepricing.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from livepricing.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, SF).select(*want.columns)
    # rows as they are: pandas would show one null in two ways
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark, tmp_path):
    sf = SF.replace("0.001", "0.01")  # enough labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns and docs.count() > 0
        if i < 3:
            assert docs.count() < n
            n = docs.count()
    assert docs.count() > 0
