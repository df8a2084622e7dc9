"""The pipeline's stages on the smallest table, each judged on its own input."""

import os

import pytest

import corpus_pipeline as c
from tonglex.llm.common import stage_table, table
from tonglex.llm.registry import ORACLES, QUERIES
from tonglex.llm.secret_scan import base_spans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    for name, stage in c.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage_table(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        counts.append(len(after))
        assert set(after) <= set(before)
        if name == "quality":
            gone = [d for d in before if d not in after and labels.get(d) == 1]
            assert all(len(before[d].split()) < 10 or len(set(before[d].split())) < 0.9 * len(before[d].split()) for d in gone)
        if name == "near_copies":
            assert len(set(after.values())) == len(after) and set(before.values()) >= set(after.values())
        if name == "secrets":
            assert not any(base_spans(t) for t in after.values())
    assert counts == sorted(counts, reverse=True) and counts[1] < counts[0] and counts[2] < counts[1]
    packed = c.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(after)
    assert c.run(spark, SF).count() == packed.count()


def test_stages_on_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in c.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings", "pages"):
        f = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, df.select(*cols).collect())) == sorted(map(key, want.select(*cols).fetchall()))
