"""Writers that keep builds comparable: sorted lines, digests, checks, refusals to overwrite, single-row upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows as a Parquet table in the shared folder, read back: what several parts of a plan read is made once."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_sorted_json(rows: DataFrame, path: str, key: str) -> None:
    """Range-partitioned, sorted JSON lines: the parts in order are the rows in order, however many there are."""
    rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of the files under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def mismatches(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(name) of expected files that are absent or differ."""
    found = checksums(spark, path).select("name", F.col("sha256").alias("_found"))
    return expected.join(found, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("_found"))).select("name")


def digest_of(spark: SparkSession, path: str) -> str:
    """One digest over the sorted names and contents' digests of a directory: first by the 4,096 prefixes of the names' own
    digests, then over those, so no task holds all entries."""
    entries = checksums(spark, path).select(F.substring(F.sha2("name", 256), 1, 3).alias("prefix"), F.concat_ws(":", "name", "sha256").alias("entry"))
    joined = lambda column: F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256)
    parts = entries.groupBy("prefix").agg(F.concat_ws(":", "prefix", joined("entry")).alias("part"))
    return parts.agg(joined("part")).first()[0]


def upsert(sheet: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """sheet with the changed rows in place of those of the same key; write it anew, then swap."""
    new = change.select(key, *[F.col(c).alias(f"_{c}") for c in change.columns if c != key], F.lit(True).alias("_new"))
    out = sheet.join(new, key, "left")
    return out.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c != key and c in change.columns else F.col(c) for c in sheet.columns])


def write_prices(rows: DataFrame, path: str) -> None:
    """Dated price rows, one directory per date; a date that is already there is refused, other dates are added."""
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for (day,) in rows.select(F.col("date").cast("string")).distinct().toLocalIterator():
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(root, f"date={day}")):
            raise ValueError(f"prices of {day} are already written")
    rows.write.partitionBy("date").mode("append").json(path)


def replace_sheet(spark: SparkSession, path: str, change: DataFrame, key: str) -> None:
    """Upserts rows into the CSV sheet at path: the new sheet is written whole beside it, then takes its place."""
    sheet = spark.read.csv(path, header=True)
    upsert(sheet, change.select(*[F.col(c).cast("string") for c in change.columns]), key).write.mode("overwrite").csv(f"{path}.new", header=True)
    name = spark._jvm.org.apache.hadoop.fs.Path
    fs = name(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(name(f"{path}.old"), True)
    fs.rename(name(path), name(f"{path}.old"))
    fs.rename(name(f"{path}.new"), name(path))
    fs.delete(name(f"{path}.old"), True)


def store_bodies(rows: DataFrame, path: str, key: str, body: str) -> None:
    """Bodies as compressed JSON lines with their digests and sizes."""
    rows.select(key, body, F.sha2(body, 256).alias("sha256"), F.octet_length(body).alias("bytes")).write.mode("append").option("compression", "gzip").json(path)


def compact_bodies(spark: SparkSession, path: str, out: str, key: str, body: str) -> tuple[int, int]:
    """Rewrites stored bodies as Parquet, one row per key; a body that doesn't match its digest is an error. (bodies, bytes)."""
    rows = spark.read.json(path)
    if wrong := rows.where(F.sha2(body, 256) != F.col("sha256")).select(key).take(1):
        raise ValueError(f"the body of {wrong[0][0]} doesn't match its digest")
    rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "sha256").alias("r")).select(key, "r.*").write.mode("errorifexists").parquet(out)
    return tuple(spark.read.parquet(out).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())


def write_levels(levels: DataFrame, path: str) -> None:
    """A load record, written anew after each level as one JSON file per level."""
    levels.repartition("concurrency").write.mode("overwrite").partitionBy("concurrency").json(path)


def write_training(examples: DataFrame, path: str, key: str = "item_id") -> DataFrame:
    """Training rows as sorted JSON lines, and their manifest (split, examples, chars) beside them, which is returned."""
    write_sorted_json(examples, f"{path}/examples", key)
    chars = F.length("system") + F.length("user") + F.length("assistant")
    manifest = examples.groupBy("split").agg(F.count("*").alias("examples"), F.sum(chars).alias("chars"))
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest
