"""Facts that arrive as a stream of files: appended once each, or kept as the latest version of every fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgermark.schemas import FACT, KEYS

FACT_KEY = ("cik", "tag", "unit", "period_start", "period_end")
VERSION = ("value", "filed_date", "accession_no", "form_type")


def arrived(spark: SparkSession, folder: str, files: int | None = None) -> DataFrame:
    """Facts of Parquet files that arrive in ``folder``, at most so many ``files`` at a time."""
    reader = spark.readStream.schema(FACT)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def fact_stream(spark: SparkSession, folder: str, late: str = "30 days") -> DataFrame:
    """Facts of Parquet files that arrive in ``folder``, without repeats of a key that arrive within ``late``."""
    rows = arrived(spark, folder).withColumn("filed_at", F.col("filed_date").cast("timestamp")).withWatermark("filed_at", late)
    return rows.dropDuplicatesWithinWatermark(KEYS["fact"]).drop("filed_at")


def append_facts(stream: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write the stream to the store; ``once`` takes what is there and ends."""
    w = stream.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()


def latest_versions(stream: DataFrame, as_of: date | None = None) -> DataFrame:
    """The latest version of every fact, filed by ``as_of`` at most, kept as the state of a stream. A restatement may come however
    late: the state has a row for each fact, and no watermark ever drops one. Versions may arrive in any order."""
    rows = stream if as_of is None else stream.where(F.col("filed_date") <= F.lit(as_of))
    latest = F.max_by(F.struct(*VERSION), F.struct("filed_date", "accession_no"))
    return rows.groupBy(*FACT_KEY).agg(latest.alias("x")).select(*FACT_KEY, "x.*")


def keep_latest(latest: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write what each batch changes, one folder for each; a batch that runs again replaces its own, so a restart neither loses
    nor doubles a change."""

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    w = latest.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every fact after all batches: of each fact what was changed last."""
    rows = spark.read.parquet(folder)
    return rows.groupBy(*FACT_KEY).agg(F.max_by(F.struct(*VERSION), "batch").alias("x")).select(*FACT_KEY, "x.*")


def folded(spark: SparkSession, folder: str, into: str) -> None:
    """Put the changes of all batches together in ``into``, a row for each fact, as one batch for later ones to go on."""
    last = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    current(spark, folder).write.mode("overwrite").parquet(f"{into}/batch={last}")


def keep_batches(stream: DataFrame, folder: str, checkpoint: str, as_of: date | None = None, once: bool = True) -> StreamingQuery:
    """Write the latest version of every fact within each batch, one folder for each; a batch that runs again replaces its own. The
    stream has no state, so its memory does not grow with the facts that arrived; ``newest`` puts the batches together."""

    def put(rows: DataFrame, batch: int) -> None:
        latest_versions(rows, as_of).write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    w = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def newest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every fact after all batches of ``keep_batches``, in whatever order they came."""
    return latest_versions(spark.read.parquet(folder))
