"""Run logs and events as streams: resumable appends, latest rows per key, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: object, files_per_trigger: int = 1000, form: str = "parquet", names: str = "*") -> DataFrame:
    """The files of a log directory, those of the given names, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", names).format(form).load(path)


#: Key buckets of a latest-wins table; a batch rewrites those that its keys fall into.
BUCKETS = 64


def _committed(spark: SparkSession, out: str) -> DataFrame:
    """(_epoch, _bucket, row columns) of the newest version of each bucket at out."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/_epoch=*")
    newest = rows.groupBy("_bucket").agg(F.max("_epoch").alias("_epoch"))
    return rows.join(newest, ["_bucket", "_epoch"], "left_semi")


def _has_table(spark: SparkSession, out: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_epoch=*")
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []) > 0


def latest_by_key(log: DataFrame, key: str, order: str, out: str, checkpoint: str, name: str = "latest") -> object:
    """Runs what is in the log through to a table of the last row per key at out; returns the ended query.

    The table is kept in buckets of keys. Each batch writes new versions of the buckets that it touches, under its epoch, which
    is written anew if the epoch is retried; so a restart neither loses nor repeats a row. Read the result with read_latest();
    drop_superseded() removes the versions that newer ones replace.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        latest = lambda df: df.groupBy("_bucket", key).agg(F.max_by(F.struct(*batch.columns), F.col(order)).alias("r")).select("_bucket", "r.*")
        whole = latest(rows)
        if _has_table(spark, out):
            touched = [r[0] for r in rows.select("_bucket").distinct().collect()]
            before = _committed(spark, out).where(F.col("_bucket").isin(touched) & (F.col("_epoch") < epoch))
            whole = latest(whole.unionByName(before.select("_bucket", *batch.columns)))
        whole.write.mode("overwrite").partitionBy("_bucket").parquet(f"{out}/_epoch={epoch}")

    query = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, out: str) -> DataFrame:
    """The table at out, whichever query run wrote it last."""
    return _committed(spark, out).drop("_epoch", "_bucket")


def drop_superseded(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Removes all but the newest keep versions of each bucket; returns how many went."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/_epoch=*/_bucket=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions: dict[str, list[tuple[int, object]]] = {}
    for status in fs.globStatus(path) or []:
        place = status.getPath()
        versions.setdefault(place.getName(), []).append((int(place.getParent().getName().split("=")[1]), place))
    gone = [place for found in versions.values() for _, place in sorted(found, key=lambda v: -v[0])[keep:]]
    for place in gone:
        fs.delete(place, True)
    return len(gone)


def append_only(log: DataFrame, out: str, checkpoint: str) -> object:
    """Appends the log's new rows to Parquet at out, exactly once over restarts; returns the ended query."""
    query = log.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, time: str, by: list[str], value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; rows later than the watermark are dropped from state."""
    w = F.window(time, length, slide) if slide else F.window(time, length)
    out = events.withWatermark(time, late).groupBy(w, *by) if events.isStreaming else events.groupBy(w, *by)
    return out.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Session windows by key: start, end and number of events."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")
