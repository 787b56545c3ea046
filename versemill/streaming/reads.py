"""Reading events as streams: live counts, debounce with a timer, and bookmarks kept current.

No lateness rule is given by the batch operators; here an event may be late by the watermark, later ones are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from versemill.sources.sinks import upsert_buckets


def live_section_counts(reads: DataFrame, units: DataFrame) -> DataFrame:
    """(ch, reads) for complete mode: the whole result comes again with each change (RX1, RX2). Each id of a read counts once,
    however late it comes again, so the state keeps all ids; put a watermark on the stream where lateness is bounded."""
    once = reads.where("verse_id is not null").dropDuplicates(["progress_id"])
    return once.join(units.select(F.col("id").alias("verse_id"), "ch"), "verse_id").groupBy("ch").agg(F.count("*").alias("reads"))


def debounced(reads: DataFrame, quiet_ms: int, late: str = "10 minutes") -> DataFrame:
    """(reader_id, progress_id, read_at): reads followed by quiet_ms without another of the reader (RX3, RX4, RX6).

    The state holds one reader's last read. A new one emits it if it came late enough; else a timer on event time does.
    """
    schema = "reader_id long, progress_id long, read_at timestamp"
    events = reads.select(F.col("reader_id").cast("long").alias("reader_id"), F.col("progress_id").cast("long").alias("progress_id"), F.col("read_at").cast("timestamp").alias("read_at"))
    events = events.where("reader_id is not null and read_at is not null").withWatermark("read_at", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, pd.Timestamp]] = []
        if state.hasTimedOut:
            last, at = state.get
            out.append((key[0], last, pd.Timestamp(at, unit="us")))
            state.remove()
        else:
            new = pd.concat(list(batches)).sort_values(["read_at", "progress_id"])
            held = state.get if state.exists else None
            for row in new.itertuples():
                at = int(row.read_at.value // 1000)
                if held is not None and (at, row.progress_id) <= (held[1], held[0]):
                    continue  # a second delivery, or one overtaken by what is held
                if held is not None and at - held[1] >= quiet_ms * 1000:
                    out.append((key[0], held[0], pd.Timestamp(held[1], unit="us")))
                held = (int(row.progress_id), at)
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] // 1000 + quiet_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["reader_id", "progress_id", "read_at"])

    return events.groupBy("reader_id").applyInPandasWithState(step, schema, "progress_id long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def keep_current(spark: SparkSession, events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps one row for each bookmark id in a table, the last delivery of each batch winning (RX7, SNK7)."""

    def write(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("bookmark_id").agg(F.max_by(F.struct("reader_id", "verse_id", "created_at"), "ingested_at").alias("r")).select("bookmark_id", "r.*")
        upsert_buckets(batch.sparkSession, latest, path, "bookmark_id")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table as a stream of its files, its schema read first; the table may be a folder or one file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
