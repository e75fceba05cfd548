import numpy as np

from voxlake.operators import runlog
from voxlake.streaming import snapshot_stream


def test_a_stream_in_three_batches_with_restarts_equals_the_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(run, step, float(rng.gamma(1, 2))) for run in range(5) for step in range(1, 61)]
    schema = "run_id long, step long, value double"
    source, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for part in range(3):
        some = [r for r in rows if (r[1] - 1) // 20 == part and not (part == 1 and r[0] == 4)]
        spark.createDataFrame(some, schema).repartition(3).write.mode("append").parquet(source)
        query = snapshot_stream(spark.readStream.schema(schema).parquet(source), out, f"file://{tmp_path}/state", 7, 2.0)  # a new query goes on from the state
        assert query.awaitTermination(120)
    known = [r for r in rows if not (r[0] == 4 and 20 < r[1] <= 40)]
    batch = runlog.loss_increase(spark.createDataFrame(known, schema), 2.0).withColumnRenamed("step", "iteration")
    want = sorted(tuple(r) for r in runlog.snapshot(batch, 7, batch.jump).select("run_id", "iteration", "value", "jump").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("run_id", "iteration", "value", "jump").collect())
    assert got == want and len([r for r in got if r[3] and r[1] % 20 == 1]) > 0  # jumps from one batch to the next are among them
