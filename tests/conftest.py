import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", "/tmp/lociweave-warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def records(spark):
    """Makes records from {locus: [(id, seq), ...]}."""

    def make(loci):
        rows = [(locus, k, name, seq) for locus, r in loci.items() for k, (name, seq) in enumerate(r)]
        return spark.createDataFrame(rows, "locus long, record_order int, seq_id string, seq string")

    return make


@pytest.fixture
def seqs():
    def collect(df, *more):
        return {(r["locus"], r["seq_id"], *[r[m] for m in more]): r["seq"] for r in df.collect()}

    return collect
