"""The pipeline's stages, and the registered queries, on the smallest tables."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from newsmood.llm import queries
from tests.conftest import rows

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        sizes.append(docs.count())
        assert all(texts[r["doc_id"]] == r["text"] for r in docs.collect())
    # Filters take away, exact copies go, and mixing loses no document.
    assert sizes[0] >= sizes[1] > sizes[2] >= sizes[3] <= sizes[4]
    assert docs.select("doc_id").distinct().count() == sizes[3]
    assert docs.select("text").distinct().count() == sizes[3]


def test_run(spark):
    got = rows(corpus_pipeline.run(spark, FOLDER))
    assert got and max(r["offset"] + r["length"] for r in got) <= 2048


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    got = queries.QUERIES[name](spark, FOLDER).toPandas()
    want = duck.execute(queries.ORACLES[name]).df()[list(got.columns)]
    key = list(got.columns)
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_batches_of_texts_are_bounded_by_bytes(spark):
    """A stage that hands whole texts to Python does so in batches of bounded bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)
    corpus_pipeline.clean(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)
    wide = spark.range(6000, numPartitions=1).selectExpr("id", "repeat('abcd', 1000) AS text")
    sizes = wide.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= 1.1 * corpus_pipeline.BATCH_BYTES and len(sizes) > 4
    spark.conf.set(name, 1 << 20)
    corpus_pipeline._bounded_batches(spark)
    assert spark.conf.get(name) == str(1 << 20)
    spark.conf.unset(name)
