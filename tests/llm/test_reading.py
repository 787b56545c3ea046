"""Reading levels: held-out accuracy on the project's labels, and the edges."""

from pyspark.sql import functions as F

from versemill.llm.reading import reading_levels


def test_held_out(spark):
    """A fifth of the labels is kept from training; of those nine in ten get the right side of level 4."""
    draft, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("draft", "reading_labels"))
    kept = labels.where("draft_id % 5 = 0")
    got = reading_levels(draft, labels.where("draft_id % 5 <> 0")).join(kept.withColumnRenamed("draft_id", "doc_id"), "doc_id")
    row = got.agg(F.count("*").alias("n"), F.count_if((F.col("level") >= 4) == (F.col("reading_level") >= 4)).alias("right"), F.count_if(F.col("level") == F.col("reading_level")).alias("same")).first()
    assert row.n > 50 and row.right >= 0.95 * row.n and row.same >= 0.75 * row.n


SCHEMA = "draft_id long, meaning_simple string, takeaway string, word string, n int"


def test_edges(spark):
    rows = [(1, "cat sat", "dog", "x", 1), (2, "epistemology transcends", None, "x", 1), (3, None, "cat", "x", 1), (4, " \n", "cat", "x", 1), (5, "<br>&nbsp;", "", "x", 1), (6, "cat dog", "sat", "x", 1), (6, "cat dog", "sat", "x", 1), (7, "transcends " * 5000, None, "x", 1), (None, "cat", "", "x", 1)]
    labels = [(1, 1), (2, 5), (2, 5), (3, 1), (9, 2), (1, None), (6, 77)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in reading_levels(df, spark.createDataFrame(labels, "draft_id long, reading_level int")).collect()}
    assert set(got) == {1, 2, 5, 6, 7} and got[6].level == 1 and got[7].level == 5 and got[5].words == 0 and got[7].words == 5000
    none = spark.createDataFrame([], "draft_id long, reading_level int")
    assert {r.level for r in reading_levels(df, none).collect()} == {1}
    assert reading_levels(df.limit(0), none).count() == 0
