import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(autouse=True)
def small_batches(spark):
    """So that every operator sees several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
