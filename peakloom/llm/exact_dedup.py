"""Exact deduplication as a stateful stream.

The documents are read as a file stream. A streaming aggregation keyed by the digest of the normalised text keeps, for
each text, the row that stays, the place of its content (file and row) and the number of rows; the state lies in RocksDB
on disk, is checkpointed to the shared folder and never expires, so later batches meet everything seen before. Rows that
hit an existing digest are then compared with the keeper's normalised text byte by byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from peakloom.llm.common import SPACE, whole_text
from peakloom.session import cut_lineage, scratch_path

#: Settings of the stream; they are put back afterwards. State memory is bounded per executor, the rest is on disk.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # many small stores: no megabytes set aside on disk for each of them
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", "")


def _rows(df: DataFrame) -> DataFrame:
    """Identifier, rank and locator of every row. The smallest rank stays: most code points, then smallest doc_id (null
    last), then place in the input, so that of wholly equal rows exactly one stays."""
    text = whole_text()
    return df.select(
        "doc_id",
        F.struct(
            (-F.char_length(text)).alias("size"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("doc_id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("place"),
        F.sha2(normalised(text), 256).alias("text_sha256"),
        normalised(text).alias("body"),
    )


def _pattern(path: str) -> str:
    """The path as a pattern that only it matches: a file stream takes a single file in this form alone."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stream_state(spark: SparkSession, path: str, bytes_per_batch: int = 256 << 20) -> DataFrame:
    """One row per distinct digest after the stream has read every file under ``path``: text_sha256, place, group_size.

    ``bytes_per_batch`` sizes the micro-batches and does not change the result.
    """
    base, before = scratch_path(spark), {k: spark.conf.get(k, None) for k in STATE_CONF}
    schema = spark.read.parquet(path).schema
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(_pattern(path))
        state = _rows(stream).groupBy("text_sha256").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("group_size"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/state/batch={number}")

        query = (
            state.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
            .option("checkpointLocation", f"{base}/checkpoint").start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    plain = spark.range(0).select(
        F.lit("").alias("text_sha256"), F.lit(0).cast("long").alias("group_size")
    ).schema
    place = _rows(spark.read.parquet(path)).select("place").schema
    fields = plain.add(place["place"])
    # an empty table makes no batch; the base holds an empty file for it
    spark.createDataFrame([], fields).write.parquet(f"{base}/state/batch=-1")
    updates = spark.read.schema(fields).parquet(f"{base}/state")
    # the counts of a digest only grow, so its largest count is its last state
    return updates.groupBy("text_sha256").agg(
        F.max_by("place", "group_size").alias("place"), F.max("group_size").alias("group_size")
    )


def deduplicate(spark: SparkSession, path: str, bytes_per_batch: int = 256 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty and white-space texts form one group. A null doc_id loses ties. Rows that are equal
    throughout form a group like any other: one of them stays. An empty table gives no rows; other columns are ignored.
    """
    groups = cut_lineage(stream_state(spark, path, bytes_per_batch).filter("group_size > 1"))
    rows = _rows(spark.read.parquet(path))
    keepers = groups.select("text_sha256", F.col("place").alias("best"), "group_size")
    lone = F.col("best").isNull()
    # the plan is the same at every size: the texts are what moves
    joined = rows.join(keepers.hint("merge"), "text_sha256", "left")
    # the bytes are needed only where a digest was hit
    table = cut_lineage(joined.select(
        "doc_id", "text_sha256", "place", F.when(lone, F.col("place")).otherwise(F.col("best")).alias("best"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.when(~lone, F.col("body")).alias("body"),
    ))
    hits = table.filter("group_size > 1")
    first = hits.filter(F.col("place") == F.col("best")).select("text_sha256", F.col("body").alias("first_body"))
    differ = hits.join(first, "text_sha256").filter(F.col("body") != F.col("first_body")).select("text_sha256").distinct()
    out = table.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best")).alias("kept"), "text_sha256"
    )
    if differ.isEmpty():
        return out
    # two texts with one digest: those rows are grouped anew by the bytes themselves
    again = hits.join(differ, "text_sha256", "left_semi")
    exact = again.groupBy("text_sha256", "body").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("group_size"))
    regrouped = again.drop("best", "group_size").join(exact, ["text_sha256", "body"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best")).alias("kept"), "text_sha256"
    )
    return out.join(differ, "text_sha256", "left_anti").select(*regrouped.columns).union(regrouped)
