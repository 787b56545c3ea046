"""The shared folder, stored frames and size checks."""

from pyspark.sql import functions as F

from versemill import runtime


class _Conf:
    def __init__(self, at):
        self.at = at

    def get(self, key, default=None):
        return self.at or default


class _Session:
    def __init__(self, spark, at):
        self.conf, self.sparkContext = _Conf(at), spark.sparkContext


def test_shared_folder(spark):
    assert runtime.shared_folder(_Session(spark, "hdfs://x/y")) == "hdfs://x/y"
    own = runtime.shared_folder(_Session(spark, None))
    assert own.startswith("file://") and runtime.shared_folder(_Session(spark, None)) == own


def test_stored(spark):
    df = spark.createDataFrame([(1, [1.5], None), (2, None, "x")], "a long, b array<double>, c string")
    assert sorted(map(tuple, runtime.stored(df).collect())) == sorted(map(tuple, df.collect()))
    empty = runtime.stored(df.limit(0))
    assert empty.count() == 0 and empty.dtypes == df.dtypes


def test_small(spark):
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    df = spark.range(1000).select(F.col("id"), F.lit(None).cast("string").alias("x"))
    assert hinted(runtime.small(df)) and not hinted(runtime.small(df, 100)) and runtime.small(df.limit(0)).count() == 0
