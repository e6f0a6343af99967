"""State that a stream carries: a cache whose rows expire, logs, counters, resumable mixtures."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import corpus

ANSWER = "key string, at double, hit boolean, payload string"


def cache(requests: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Replays puts and gets against a cache per key.

    requests have key, at (seconds), kind (put or get), expires and payload. A
    get is answered: it hits if the row's expiry is later than the request;
    what has expired is forgotten. State is one row per live key. Requests of
    one key are taken in order of `at` within a micro-batch.

    A row leaves the state by itself once the watermark, the latest `at` less the
    lateness, has passed its expiry: a timer is set for it, no request is needed.
    Requests that come later than that aren't answered.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            held = state.get if state.exists else None
            for r in pd.concat(list(frames)).sort_values(["at", "kind"], ascending=[True, False]).itertuples():
                if held is not None and held[0] <= r.at:
                    held = None
                if r.kind == "put":
                    held = (float(r.expires), r.payload)
                else:
                    out.append((key[0], float(r.at), held is not None, held[1] if held else None))
            ends = math.ceil(held[0] * 1000) if held is not None else 0
            if held is not None and ends > state.getCurrentWatermarkMs():
                state.update(held)
                state.setTimeoutTimestamp(ends)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])

    timed = requests.withColumn("_time", F.timestamp_micros((F.col("at") * 1_000_000).cast("long"))).withWatermark("_time", lateness)
    return timed.groupBy("key").applyInPandasWithState(run, ANSWER, "expires double, payload string", "append", GroupStateTimeout.EventTimeTimeout)


def metrics_by_run(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """The latest row of each run of an append-only log, updated as it grows."""
    rest = [c for c in log.columns if c not in (run, step)]
    return log.groupBy(run).agg(F.max(step).alias(step), F.max_by(F.struct(*rest), step).alias("r")).select(run, step, "r.*")


def service_counters(requests: DataFrame, status: str = "status") -> DataFrame:
    """Running counts of accepted requests, failures and refusals."""
    s = F.col(status)
    return requests.groupBy().agg(F.count("*").alias("requests"), F.count_if(s.isin(503, 504)).alias("errors"), F.count_if(s == 429).alias("busy"))


def resumed_mixture(sources: DataFrame, total: int, ratio: float, chunk: int, emitted: int, count: int) -> DataFrame:
    """The next `count` tokens of a mixture of which `emitted` are out already."""
    return corpus.mixture_tokens(sources, total, ratio, chunk, emitted, emitted + count)


def resumed_epochs(rows: DataFrame, order: str, epochs: int, epoch: int = 0, cursor: int = 0) -> DataFrame:
    """epoch, place and the row of what is left of `epochs` passes over rows in
    order, from `cursor` rows into `epoch`. order is a whole number from 0."""
    passes = rows.sparkSession.range(epoch, epochs).select(F.col("id").alias("epoch"))
    # A handful of epochs, each of which is a pass over all rows by definition.
    every = rows.withColumn("epoch", F.explode(F.array(*[F.lit(r).cast("long") for r in range(epoch, max(epoch, epochs))]).cast("array<long>"))) if epochs > epoch else rows.join(passes, F.lit(False))
    return every.where((F.col("epoch") > epoch) | (F.col(order) >= cursor))


def shuffled_batches(stream: DataFrame, key: str, seed: int, path: str):
    """A stream written in a repeatable random order within each micro-batch (the
    bounded buffer). A batch that is run again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.orderBy(F.xxhash64(F.lit(seed), F.lit(number), F.col(key)), key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).trigger(availableNow=True)


LAG = "batch long, rows long, files long, waiting long"


def admitted(spark: SparkSession, source: str, schema: str, path: str, files_per_batch: int) -> DataFrame:
    """Drain a folder of Parquet files into path, at most `files_per_batch` of them at
    a time, and return LAG: what each batch took and how many files waited then.

    A burst is spread over batches, each of which is committed with its row of the
    log; a run that is stopped goes on where it was. Rows aren't dropped or held
    in memory: what isn't admitted yet stays in the folder.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source).select("*", F.col("_metadata.file_path").alias("_file"))

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("_file").write.mode("overwrite").parquet(f"{path}/out/batch={number}")
        seen = batch.agg(F.lit(number).cast("long").alias("batch"), F.count("*").alias("rows"), F.count_distinct("_file").alias("files"))
        seen.withColumn("listed", F.lit(_listed(spark, source)).cast("long")).write.mode("overwrite").parquet(f"{path}/log/of={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    log = spark.read.schema("batch long, rows long, files long, listed long").parquet(f"{path}/log")
    done = F.sum("files").over(Window.orderBy("batch"))  # a row per batch
    return log.select("batch", "rows", "files", (F.col("listed") - done).alias("waiting"))


def _listed(spark: SparkSession, folder: str) -> int:
    """Data files of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sum(not s.getPath().getName().startswith(("_", ".")) for s in found)


def written(spark: SparkSession, stream: DataFrame, mode: str, root: str) -> DataFrame:
    """Run a bounded stream to its end, into files (append) or, where results are
    a table of their own size (complete), into one overwritten table; read back."""
    path = f"{root}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").option("path", f"{path}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")

