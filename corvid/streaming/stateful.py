"""Stateful folds over events: rate limiter, circuit breaker, operation states; for batches and, by key, for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Requests of a window, its seconds; failures that open a breaker, seconds until it tries again.
LIMIT, WINDOW_S, FAILURES, RECOVERY_S = 120, 60, 5, 30


def limiter_step(state: dict, t: float, limit: int = LIMIT, window: float = WINDOW_S) -> bool:
    """Fixed windows that start at a key's first request."""
    if not state or t - state["start"] >= window:
        state.update(start=t, n=0)
    state["n"] += 1
    return state["n"] <= limit


def breaker_step(state: dict, t: float, failed: bool, failures: int = FAILURES, recovery: float = RECOVERY_S) -> str:
    """closed, open or half_open after the event; a failure while half open doesn't open it again, a success closes it."""
    state.setdefault("name", "closed")
    state.setdefault("n", 0)
    if state["name"] == "open" and t - state["at"] >= recovery:
        state["name"] = "half_open"
    if not failed:
        state.update(name="closed", n=0)
    elif state["name"] == "closed":
        state["n"] += 1
        if state["n"] >= failures:
            state.update(name="open", at=t)
    return state["name"]


#: Which state may follow which.
NEXT = {"accepted": {"running", "failed"}, "running": {"succeeded", "failed"}}


def operation_step(state: dict, wanted: str, report: str) -> str:
    """ok, replay (the same end again) or conflict."""
    now = state.get("name", "accepted")
    if now == wanted and state.get("report") == report:
        return "replay"
    if wanted not in NEXT.get(now, set()):
        return "conflict"
    state.update(name=wanted, report=report)
    return "ok"


def fold(events: DataFrame, key: str, order: str, columns: list[str], step: Callable, out: str) -> DataFrame:
    """``step(state, *columns)`` over each key's events in order. Rows are sorted within partitions and streamed, so a
    hot key is one pass in constant memory and never a group that must be held."""
    import pyarrow as pa

    rows = events.select(F.col(key).alias("key"), F.col(order).alias("order"), *columns).repartition("key").sortWithinPartitions("key", "order")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + f", `{out}` string"

    def run(batches):
        key_now, state = object(), {}
        for b in batches:
            got = []
            for row in zip(*(b.column(i).to_pylist() for i in (0, *range(2, b.num_columns)))):
                if row[0] != key_now:
                    key_now, state = row[0], {}
                got.append(str(step(state, *row[1:])).lower())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return rows.mapInArrow(run, schema)


def ingest_stream(spark, source: str, schema: str, sink: str, checkpoint: str, files: int = 100):
    """New files of documents, deduplicated by content hash within the watermark, appended to a sink; runs until no file is left."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    df = df.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).withColumn("at", F.current_timestamp())
    df = df.withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["content_hash"])
    return df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
