"""Reading and writing event tables: JSON lines, idempotent appends, layouts, retention, exports."""

from __future__ import annotations

import tempfile
import datetime
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

#: The delivered fields in their order, and their types (fixed values).
ENVELOPE = StructType(
    [StructField(n, StringType()) for n in ("envelope_version", "event_id", "workspace_id", "stream_id")]
    + [StructField("shard_id", IntegerType())]
    + [StructField(n, StringType()) for n in ("scenario_slug", "manifest_version", "event_type")]
    + [StructField("schema_ref", StructType([StructField("subject", StringType()), StructField("version", IntegerType())]))]
    + [StructField("sequence_no", LongType()), StructField("partition_key", StringType())]
    + [StructField(n, TimestampType()) for n in ("occurred_at", "emitted_at")]
    + [StructField(n, StringType()) for n in ("actor_id", "session_id")]
    + [StructField("entity_refs", ArrayType(StructType([StructField("entity_type", StringType()), StructField("entity_key", StringType())])))]
    + [StructField(n, StringType()) for n in ("correlation_id", "causation_id", "op", "payload")]
)

#: Null fields keep their key; times have six digits and Z.
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
JSON = {"ignoreNullFields": "false", "timestampFormat": TIME, "timeZone": "UTC"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a new one where it isn't set and the master is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: nothing before it runs twice or again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt over several tasks for each core by its keys.  A small file is one task, and few groups are few, however much is made of each row."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *keys)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_events(spark: SparkSession, path: str, schema: StructType = ENVELOPE) -> DataFrame:
    """Delivered events in JSON lines, plain or gzip; the payload stays text."""
    return spark.read.schema(schema).options(timestampFormat=TIME, timeZone="UTC").json(path)


def write_jsonl(df: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON document a line, without internal columns; null fields keep their key."""
    cols = [c for c in df.columns if not c.startswith("_df")]
    df.select(F.to_json(F.struct(*cols), JSON).alias("value")).write.option("compression", compression).text(path)


#: Buckets of a table that is appended to by key.
BUCKETS = 32


def touched_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> tuple[DataFrame, list[int]]:
    """``df`` with the bucket of each row's keys, and the buckets that it has rows for: ``buckets`` at most."""
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    return df, sorted(r[0] for r in df.select("_bucket").distinct().collect())


def append_idempotent(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Append the rows whose keys the table doesn't have; of equal keys in ``df`` that with the least hash of its columns.  Returns the table.

    One writer at a time, as a foreachBatch sink is.  The table is laid out in directories by hash bucket of the keys, and an append
    reads the keys of the buckets that it has rows for only; a table whose appends are small wants more buckets.  The number must stay the same for a table.
    """
    spark = df.sparkSession
    new, touched = touched_buckets(df, keys, buckets)
    if not touched:
        return spark.read.schema(df.schema).parquet(path).select(*df.columns) if exists(spark, path) else df.limit(0)
    if exists(spark, path):
        new = new.join(known_keys(spark, path, new, keys, touched), ["_bucket", *keys], "left_anti").select(*new.columns)
    least = F.min_by(F.struct(*df.columns), F.xxhash64(*df.columns))
    new = new.groupBy("_bucket", *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(least.alias("_row")).select("_row.*", "_bucket")
    new.repartition("_bucket").write.partitionBy("_bucket").mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def known_keys(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str], touched: Sequence[int]) -> DataFrame:
    """The keys that a bucketed table has in some buckets."""
    return spark.read.schema(like.schema).parquet(path).where(F.col("_bucket").isin(list(touched))).select("_bucket", *keys)


def with_buffer_seq(df: DataFrame, stored: DataFrame | None, order: Sequence[str], now: Column) -> DataFrame:
    """Per stream a buffer_seq that carries on from the stored maximum, and a partition_ts that doesn't fall."""
    from eventlab.operators.ranges import with_running

    numbered = with_running(df, ["stream_id"], order, F.lit(1).cast("long"), "sum", "_nth")
    if stored is None:
        return numbered.withColumn("buffer_seq", F.col("_nth")).withColumn("partition_ts", now).drop("_nth")
    top = stored.groupBy("stream_id").agg(F.max("buffer_seq").alias("_seq"), F.max("partition_ts").alias("_ts"))
    both = numbered.join(top, "stream_id", "left")
    return both.withColumn("buffer_seq", F.col("_nth") + F.coalesce("_seq", F.lit(0))).withColumn("partition_ts", F.greatest(now, F.col("_ts"))).drop("_nth", "_seq", "_ts")


def with_partitions(df: DataFrame, time: str, hour: bool = True) -> DataFrame:
    """``dt`` and, for hourly layouts, ``hour``, in UTC."""
    df = df.withColumn("dt", F.to_date(time))
    return df.withColumn("hour", F.hour(time)) if hour else df


def write_partitioned(df: DataFrame, path: str, time: str, hour: bool = True) -> None:
    by = ["dt", "hour"] if hour else ["dt"]
    split(with_partitions(df, time, hour), by, time).write.partitionBy(*by).parquet(path)


def split(df: DataFrame, by: Sequence[str], *order: str) -> DataFrame:
    """Rows of a directory together and in order, but ranges of rows in a task: a large hour or day has several files."""
    return df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)


def _horizon(now: str, hours: int) -> tuple[str, Column]:
    """Whole hours, or whole days for multiples of 24 from a week on, and the first of them that stays."""
    unit = "day" if hours % 24 == 0 and hours >= 24 * 7 else "hour"
    return unit, F.date_trunc(unit, F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours)))


def apply_retention(df: DataFrame, now: str, time: str, hours: int) -> DataFrame:
    """Rows of partitions inside the retention horizon."""
    unit, horizon = _horizon(now, hours)
    return df.where(F.date_trunc(unit, time) >= horizon)


def drop_expired(spark: SparkSession, path: str, now: str, hours: int) -> DataFrame:
    """Remove the directories (dt, or dt and hour) of a partitioned table that lie before the retention horizon; returns (folder, files, bytes) of what went.

    Directories are listed and removed by name: no data is read, and what stays is not touched.  A directory whose name isn't a
    date or hour is left alone; a day is left when its last hour is.
    """
    horizon = spark.range(1).select(_horizon(now, hours)[1].alias("h")).first()["h"]
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []

    def parts(folder, name: str):
        for status in fs.listStatus(folder):
            key, _, value = status.getPath().getName().partition("=")
            if status.isDirectory() and key == name:
                yield status.getPath(), value

    def drop(folder) -> None:
        size = fs.getContentSummary(folder)
        gone.append((folder.toString(), size.getFileCount(), size.getLength()))
        fs.delete(folder, True)

    for day, text in parts(root, "dt"):
        try:
            begin = datetime.datetime.fromisoformat(text)
        except ValueError:
            continue
        if begin + datetime.timedelta(days=1) <= horizon:
            drop(day)
        elif begin < horizon:
            for hour, h in parts(day, "hour"):
                if h.isdigit() and begin + datetime.timedelta(hours=int(h) + 1) <= horizon:
                    drop(hour)
    return spark.createDataFrame(gone, "folder string, files long, bytes long")


def export_hourly(df: DataFrame, path: str, max_records: int) -> None:
    """Directories by hour of event time, rows in order of shard and sequence, files of bounded size."""
    laid = split(with_partitions(df, "occurred_at"), ["dt", "hour"], "shard_id", "sequence_no")
    laid.write.partitionBy("dt", "hour").option("maxRecordsPerFile", max_records).parquet(path)


def export_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per file: rows, first and last sequence number, bytes."""
    df = spark.read.parquet(path)
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min("sequence_no").alias("first"), F.max("sequence_no").alias("last"), F.max("_metadata.file_size").alias("bytes"))


def export_by_subject(df: DataFrame, path: str, subjects: dict[str, str]) -> dict[str, str]:
    """A table for each event type with typed payload columns, by day of event time; returns the paths."""
    out = {}
    for subject, ddl in subjects.items():
        rows = df.where(F.col("event_type") == subject).withColumn("_p", F.from_json("payload", ddl))
        rows = rows.select(*[c for c in df.columns if c != "payload"], "_p.*")
        out[subject] = f"{path}/{subject}"
        split(with_partitions(rows, "occurred_at", hour=False), ["dt"], "stream_id", "sequence_no").write.partitionBy("dt").parquet(out[subject])
    return out


def export_cdc(df: DataFrame, path: str, entity: str, time: str) -> None:
    """The payload documents of change rows alone, a directory for each entity, day and hour."""
    laid = df.select(F.col(entity).alias("entity"), F.to_date(time).alias("dt"), F.hour(time).alias("hour"), F.col(time).alias("_at"), F.xxhash64("payload").alias("_tie"), "payload.*")
    split(laid, ["entity", "dt", "hour"], "_at", "_tie").drop("_at", "_tie").write.partitionBy("entity", "dt", "hour").parquet(path)


def kafka_records(df: DataFrame, key: str) -> DataFrame:
    """(key, value) of message records: the partition key's bytes and the document."""
    cols = [c for c in df.columns if not c.startswith("_df")]
    return df.select(F.col(key).cast("binary").alias("key"), F.to_json(F.struct(*cols), JSON).alias("value"))


def bridge(spark: SparkSession, path: str, schema: StructType, sink: str, checkpoint: str) -> None:
    """Hand on what is new in a table of files, at least once, from where the checkpoint stands."""
    q = spark.readStream.schema(schema).parquet(path).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
