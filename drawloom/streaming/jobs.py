"""Structured Streaming twins of ingest, reconciliation, issuing, scoring and coverage.

Every job reads files as they arrive, runs with ``availableNow`` (all new data, then stop; the same call
resumes from its checkpoint), and writes to a Parquet path. Sinks written by ``foreachBatch`` are keyed, so a
batch that is repeated after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from drawloom.operators import prospective
from drawloom.sources import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    # State lives in RocksDB on disk for every job, not on the heap.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_batches(stream: DataFrame, checkpoint: str, on_batch) -> None:
    query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_append(stream: DataFrame, checkpoint: str, path: str, width: int | None = None) -> None:
    """``width``: partitions of the state where not the session's shuffle width; the first run of a checkpoint fixes them."""
    spark, key = stream.sparkSession, "spark.sql.shuffle.partitions"
    usual = spark.conf.get(key)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    try:
        if width is not None:
            spark.conf.set(key, width)
        started = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, usual)
    started.awaitTermination()


# --- ingest ------------------------------------------------------------------------------


def ingest(stream: DataFrame, ledger: str, checkpoint: str, keys: list[str], payload: list[str]) -> None:
    """Observation log fed by a stream. A replay adds nothing, by key in the ledger, and a new key is logged however
    late it comes; a changed payload goes to the ledger's reject side, never over the old row. No state is kept, so
    nothing depends on a watermark."""
    rejects = ledger + "_rejects"

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        refused = sinks.append_keyed(batch, ledger, keys, payload)
        refused.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")

    run_batches(stream, checkpoint, on_batch)


# --- reconciliation ------------------------------------------------------------------------

_MAINS, _BONUS = T.StructField("mains", T.ArrayType(T.IntegerType())), T.StructField("bonus", T.IntegerType())
_NOW = T.StructType([_MAINS, _BONUS, T.StructField("disputed", T.BooleanType()), T.StructField("epoch", T.IntegerType()), T.StructField("revision", T.IntegerType())])
_CLAIM = T.StructType([_MAINS, _BONUS, T.StructField("epoch", T.IntegerType()), T.StructField("arrival_seq", T.IntegerType()), T.StructField("then", T.StringType()), T.StructField("said", T.StringType())])
OUTCOME = T.StructType(
    [
        T.StructField("game", T.StringType()),
        T.StructField("draw_date", T.DateType()),
        T.StructField("arrival_seq", T.IntegerType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("revision", T.IntegerType()),
    ]
)


def _differs(mains: list[int], bonus: int | None, now: list[int], now_bonus: int | None) -> bool:
    return mains != now or (bonus is not None and now_bonus is not None and bonus != now_bonus)


#: Draws of a state partition, about. Each costs a store and a worker in every trigger, whatever it holds.
STATE_DRAWS = 100


def state_width(spark: SparkSession, draws: int) -> int:
    """State partitions for about so many draws: no more than the session's shuffle width."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-draws // STATE_DRAWS)))


class Reconcile(StatefulProcessor):
    """Numbers of one draw under observations and operator resolutions; a trigger's events are taken in arrival order.

    Two states: what is stored now, and the list of claims that a resolution may overrule (accepted ones and those that
    contradicted). The list is read only when a resolution comes, or when its epoch learns the bonus.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._now = handle.getValueState("now", _NOW)
        self._claims = handle.getListState("claims", _CLAIM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = []
        for part in rows:  # slim tuples, not frames; a trigger's rows of one draw at most
            events += [(int(seq), [int(n) for n in m], None if pd.isna(b) else int(b), bool(r)) for seq, m, b, r in zip(part["arrival_seq"], part["mains"], part["bonus"], part["resolves"])]
        mains, bonus, disputed, epoch, revision = self._now.get() if self._now.exists() else (None, None, False, 0, 0)
        mains, out, fresh = None if mains is None else list(mains), [], []
        for seq, numbers, extra, resolves in sorted(events, key=lambda e: e[0]):
            review = False
            if resolves and not disputed:
                outcome = "premature"
            elif resolves:
                mains, bonus, disputed, epoch, review, outcome = numbers, extra, False, epoch + 1, True, "resolved"
            elif mains is None:
                mains, bonus, outcome = numbers, extra, "accepted"
                fresh.append((numbers, extra, epoch, seq, outcome, outcome))
            else:
                clash = _differs(numbers, extra, mains, bonus)
                outcome = "quarantined" if clash or disputed else "corroborated"
                if clash:
                    fresh.append((numbers, extra, epoch, seq, outcome, outcome))
                elif outcome == "corroborated" and bonus is None and extra is not None:
                    bonus, review = extra, epoch > 0
                disputed = disputed or clash
            out.append((seq, outcome))
            if review:
                self._claims.appendList(fresh) if fresh else None
                fresh = []
                out += self._reviewed(mains, bonus, epoch)
        if fresh:
            self._claims.appendList(fresh)
        self._now.update((mains, bonus, disputed, epoch, revision + len(out)))
        yield pd.DataFrame([(key[0], key[1], seq, outcome, revision + k) for k, (seq, outcome) in enumerate(out)], columns=[f.name for f in OUTCOME])

    def _reviewed(self, mains: list[int], bonus: int | None, epoch: int) -> list[tuple[int, str]]:
        """Claims of earlier epochs whose outcome is another one under the resolved numbers."""
        held, changed = [], []
        for claimed, extra, since, seq, then, said in self._claims.get():
            want = said
            if since < epoch:
                want = "superseded" if _differs(list(claimed), extra, mains, bonus) else then
            if want != said:
                changed.append((int(seq), want))
            held.append((list(claimed), extra, since, seq, then, want))
        if changed:
            self._claims.put(held)
        return changed

    def close(self) -> None:
        pass


def reconcile(stream: DataFrame) -> DataFrame:
    """Outcomes of valid observations and of resolutions (rows with ``resolves``), numbered by ``revision`` within a draw.

    An observation that a resolution overrules comes once more, as superseded; its greatest revision counts.
    """
    resolves = F.col("resolves") if "resolves" in stream.columns else F.lit(False)
    picked = stream.select("game", "draw_date", "arrival_seq", "mains", "bonus", resolves.alias("resolves"))
    return picked.groupBy("game", "draw_date").transformWithStateInPandas(
        statefulProcessor=Reconcile(), outputStructType=OUTCOME, outputMode="Append", timeMode="None"
    )


# --- issuing and scoring ---------------------------------------------------------------------


def classify(requests: DataFrame, results: DataFrame, deadlines: DataFrame) -> DataFrame:
    """Issue requests as they are recorded, against the deadline table and the results known so far (stream-static)."""
    return prospective.classify_issues(requests, results, deadlines)


def score(lines: DataFrame, results: DataFrame, ledger: str, checkpoint: str, watermark: str | None = None) -> None:
    """Issued lines joined to accepted results as both arrive; each new evidence of a draw appends a revision.

    Without a watermark (the default) both sides stay in state, so a correction that comes years later still meets
    its lines: the state grows with the issued lines. With a watermark, lines and results older than it are dropped
    from state, and later corrections need a batch ``score_pass``.
    """
    line_key = prospective.LINE
    settled = results.filter("status = 'accepted' and evidence is not null").select(
        "game", "draw_date", "evidence", F.col("mains").alias("outcome"), "result_at"
    )
    if watermark:
        lines = lines.withWatermark("issued_at", watermark)
        settled = settled.withWatermark("result_at", watermark)
    joined = lines.join(settled, ["game", "draw_date"])

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*line_key, "evidence", "result_at", F.size(F.array_intersect("mains", "outcome")).alias("matched"))
        like = rows.withColumn("revision", F.lit(0).cast("long"))
        known = sinks.stored(spark, ledger, like)
        fresh = rows.dropDuplicates([*line_key, "evidence"]).join(known.select(*line_key, "evidence"), [*line_key, "evidence"], "left_anti")
        last = known.groupBy(*line_key).agg(F.max("revision").alias("_last"))
        order = Window.partitionBy(*line_key).orderBy("result_at", "evidence")  # new evidence of one line in one trigger
        numbered = fresh.withColumn("_n", F.row_number().over(order)).join(last, line_key, "left")
        out = numbered.withColumn("revision", F.coalesce("_last", F.lit(0)).cast("long") + F.col("_n"))
        out.select(*like.columns).write.mode("append").parquet(ledger)

    run_batches(joined, checkpoint, on_batch)


# --- coverage ---------------------------------------------------------------------------------


def weekly_coverage(events: DataFrame, event_time: str = "ts", delay: str = "2 days") -> DataFrame:
    """Scheduled, completed and failed events per seven-day window; a window is emitted once the watermark passes it."""
    kind = F.col("event_type")
    return (
        events.withColumn(event_time, F.col(event_time).cast("timestamp"))
        .withWatermark(event_time, delay)
        .groupBy(F.window(event_time, "7 days").alias("w"))
        .agg(
            F.count_if(kind == "signup").alias("scheduled"),
            F.count_if(kind == "purchase").alias("completed"),
            F.count_if(kind == "error").alias("failed"),
        )
        .select(F.col("w.start").alias("window_start"), "scheduled", "completed", "failed")
    )
