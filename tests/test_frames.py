"""What a task makes of blocks is given on in small frames, however many blocks it is handed at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from voxlake.operators import blocks as B
from voxlake.operators import predict
from voxlake.sources import arrays, sections

BOX, CHUNK, N = ((0, 0, 0), (4, 64 * 400, 64)), (4, 64, 64), 400


def model():
    return lambda a: np.stack([a[1:-1, 1:-1, 1:-1], -a[1:-1, 1:-1, 1:-1]]).astype(np.float64)


STAGES = {
    "map_blocks": lambda b: B.map_blocks(b, lambda a: a * 2.0, "float64"),
    "predict_blocks": lambda b: predict.predict_blocks(b, model, tuple(c + 2 for c in CHUNK), CHUNK, BOX, 2),
    "prediction_sweep": lambda b: predict.prediction_sweep(b, {1: model}, tuple(c + 2 for c in CHUNK), CHUNK, BOX),
    "strips": lambda b: sections.blocks_to_strips(b),
    "cut": lambda b: arrays._cut(b, arrays.Layout(*BOX, (3, 32, 48), "int32"), BOX),
}


@pytest.mark.parametrize("stage", STAGES)
def test_frames_are_small(spark, monkeypatch, stage):
    shape = {"predict_blocks": (8, 64, 64), "prediction_sweep": (6, 66, 66)}.get(stage, CHUNK)  # both classes of a chunk; a grown chunk
    kind = "float64" if stage == "predict_blocks" else "int32"
    rows = [(0, k, 0, 0, 64 * k, 0, *shape, kind, bytes(np.dtype(kind).itemsize * int(np.prod(shape)))) for k in range(N)]
    first = spark.createDataFrame([(*rows[0][:-1], bytearray(rows[0][-1]))], B.SCHEMA)
    seen, real = [], DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, f, schema, *a, **k: (seen.append((f, schema)), real(self, f, schema, *a, **k))[1])
    STAGES[stage](first)
    f, schema = seen[-1]
    batch = pd.DataFrame(rows, columns=B.COLUMNS).assign(iteration=1, mask=None, mask_dtype=None)
    frames = list(f(iter([batch])))
    made = [sum(map(len, x["data"])) for x in frames]
    assert len(frames) > 1 and max(made) <= 5 << 20
    assert {len(x.columns) for x in frames} == {len(schema.split(", "))}
    assert sum(made) >= N * 4 * 64 * 64
