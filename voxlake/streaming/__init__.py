"""Run logs as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runlog import log_scalars, snapshot


def append_log(stream: DataFrame, path: str, checkpoint: str, every: int) -> StreamingQuery:
    """Append every n-th step of a stream of scalars to a Parquet log; stops when the input at hand is read.

    A batch that is run again writes to its own folder, so it replaces its rows rather than repeating them.
    """

    def put(batch: DataFrame, number: int) -> None:
        log_scalars(batch, every).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loss_increase_stream(stream: DataFrame, factor: float) -> DataFrame:
    """(run_id, step, value, jump) of a stream of losses (run_id, step, value), as ``runlog.loss_increase`` gives over all of it.

    The state of a run is its last step and loss, so a restart goes on where the last batch ended. Steps of a run are to come in order from batch
    to batch, in any order within one; a step that comes after a later one is compared with the latest loss known, and is not remembered.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, loss = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("step", kind="stable")  # a run's rows of one micro-batch
        out = []
        for r in rows.itertuples():
            out.append((key[0], int(r.step), float(r.value), loss is not None and loss * factor < r.value))
            if step is None or r.step >= step:
                step, loss = int(r.step), float(r.value)
        state.update((step, loss))
        yield pd.DataFrame(out, columns=["run_id", "step", "value", "jump"])

    kind = dict(stream.dtypes)["run_id"]
    rows = stream.filter("value IS NOT NULL").select("run_id", F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
    return rows.groupBy("run_id").applyInPandasWithState(run, f"run_id {kind}, step long, value double, jump boolean", "step long, loss double", "append", GroupStateTimeout.NoTimeout)


def snapshot_stream(stream: DataFrame, path: str, checkpoint: str, every: int, factor: float) -> StreamingQuery:
    """Keep every n-th step and those where the loss jumped of a stream of losses; stops when the input at hand is read."""

    def put(batch: DataFrame, number: int) -> None:
        kept = snapshot(batch.withColumnRenamed("step", "iteration"), every, F.col("jump"))
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows = loss_increase_stream(stream, factor)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
