import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from riskloom.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test data not mounted")


def test_registry():
    assert [n for n in range(1, 14) if sum(name.startswith(f"op{n}_") for name in QUERIES) != 1] == []
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = QUERIES[name](spark, DATA)
    expected = connection.execute(ORACLES[name])
    names = sorted(result.columns)
    order = [d[0] for d in expected.description]
    assert names == sorted(order)
    place = [order.index(n) for n in names]
    want = sorted(repr(tuple(r[i] for i in place)) for r in expected.fetchall())
    assert sorted(repr(tuple(r)) for r in result.select(names).collect()) == want


def odd_documents(spark):
    """The small table with NULLs in every column, empty and repeated rows, and columns with clashing names."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    nulls = docs.limit(1)
    extra = [nulls.withColumn(c, F.lit(None).cast(docs.schema[c].dataType)) for c in docs.columns]
    extra += [nulls.withColumns({"doc_id": F.lit(90_001).cast("bigint"), "text": F.lit("")}), docs.where("doc_id = 3")]
    for more in extra:
        docs = docs.union(more)
    return docs.withColumns({c: F.lit(1) for c in ("score", "_key", "size", "_print", "_rank", "group", "_kept", "_size", "target")})


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, stage):
    name, apply = corpus_pipeline.STAGES[stage]
    docs = odd_documents(spark)
    out = apply(spark, docs, DATA)
    rows = out.count()
    empty = apply(spark, docs.limit(0), DATA)
    assert empty.count() == 0 and empty.columns == out.columns
    if stage == 4:
        return
    assert out.columns == docs.columns and rows > 0
    kept = {tuple(r) for r in out.collect()}
    assert kept <= {tuple(r) for r in docs.collect()}
    if name == "simhash_near_dedup":
        found = QUERIES["op6_simhash_near_dedup"](spark, DATA).where("doc_id = component_id").count()
        # one of each component; the rows without text or with an empty one are one component more
        assert rows == found + 1
    if name == "benchmark_decontamination":
        bad = {r["doc_id"] for r in QUERIES["op10_benchmark_decontamination"](spark, DATA).where("contaminated").collect()}
        assert bad.isdisjoint({r["doc_id"] for r in out.collect()})
        assert rows == docs.where(~F.col("doc_id").isin(bad) | F.col("doc_id").isNull()).count()


def test_pipeline(spark):
    slots = corpus_pipeline.run(spark, DATA)
    documents = {i for r in slots.collect() for i in r["doc_ids"]}
    scores = QUERIES["op2_toxicity"](spark, DATA)
    toxic = {r["doc_id"] for r in scores.where("predicted = 1").collect()}
    bad = {r["doc_id"] for r in QUERIES["op10_benchmark_decontamination"](spark, DATA).where("contaminated").collect()}
    assert len(documents) > 30 and documents.isdisjoint(toxic | bad)
