"""The registered queries: SQL counterparts, and the pipeline's stages one by one."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from tillwise.llm import queries as corpus

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for held in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {held} AS SELECT * FROM '{SMALL}/{held}.parquet'")
    result = con.execute(corpus.oracle_sql()[name])
    names = [c[0] for c in result.description]
    columns = sorted(names)
    theirs = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    found = corpus.queries()[name](spark, SMALL)
    assert columns == sorted(found.columns)
    ours = [tuple(row) for row in found.select(columns).collect()]
    at = columns.index("doc_id")
    assert sorted(ours, key=lambda r: r[at]) == sorted(theirs, key=lambda r: r[at]) and ours


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append(docs.count())
        assert docs.columns == (columns if i < 4 else [*columns, "shard", "slot"])
    assert 0 < kept[2] <= kept[1] <= kept[0] <= 200 and kept[4] == kept[3] >= kept[2]
