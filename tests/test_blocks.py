import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import blocks as B
from voxlake.operators import neighbourhood as N
from voxlake.operators import predict


def voxels(spark, a):
    at = np.argwhere(np.ones(a.shape, bool))
    rows = [(*map(int, p), float(a[tuple(p)])) for p in at]
    return spark.createDataFrame(rows, "z long, y long, x long, v double")


def back(df, shape, fill=0):
    a = np.full(shape, fill, float)
    for r in df.collect():
        a[r.z, r.y, r.x] = r.v
    return a


def volume(shape=(6, 9, 7), seed=0):
    return np.random.default_rng(seed).integers(0, 5, shape)


@pytest.mark.parametrize("chunk", [(2, 4, 3), (6, 9, 7), (4, 4, 4), (1, 2, 7)])
def test_round_trip_for_any_chunk(spark, chunk):
    a = volume()
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, "int16")
    assert (back(B.blocks_to_voxels(blocks), a.shape) == a).all()


@pytest.mark.parametrize("chunk", [(2, 4, 3), (6, 9, 7), (1, 1, 2)])
@pytest.mark.parametrize("fill", [0, 3, "edge"])
def test_halo_does_not_depend_on_the_chunks(spark, chunk, fill):
    a = volume()
    context = (1, 2, 1)
    wide = np.pad(a, [(c, c) for c in context], **({"mode": "edge"} if fill == "edge" else {"constant_values": fill}))
    want = sum(wide[z : z + 6, y : y + 9, x : x + 7] * (z + 2 * y + 4 * x) for z in range(3) for y in range(5) for x in range(3))

    def kernel(b):
        n = [s - 2 * c for s, c in zip(b.shape, context)]
        b = b.astype(np.int64)
        return sum(b[z : z + n[0], y : y + n[1], x : x + n[2]] * (z + 2 * y + 4 * x) for z in range(3) for y in range(5) for x in range(3))

    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, "int16")
    got = B.blocks_to_voxels(B.with_halo(blocks, context, kernel, ((0, 0, 0), a.shape), chunk, fill, "int64"))
    assert (back(got, a.shape) == want).all()


def test_mean_fill_is_each_blocks_own(spark):
    a = np.array([[[1, 1, 1, 1], [1, 1, 9, 9]]])
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (1, 2, 2), "int16")
    got = B.with_halo(blocks, (1, 0, 0), lambda b: b[:1].astype(np.int64), ((0, 0, 0), a.shape), (1, 2, 2), "mean", "int64")
    assert (back(B.blocks_to_voxels(got), a.shape) == [[[1, 1, 5, 5], [1, 1, 5, 5]]]).all()


@pytest.mark.parametrize("chunk", [(2, 4, 3), (3, 3, 7)])
def test_block_masks_equal_voxel_masks(spark, chunk):
    a = (volume(seed=3) > 0).astype(int)
    box = ((0, 0, 0), a.shape)
    grid = voxels(spark, a)
    fg = grid.filter("v != 0").select("z", "y", "x")
    want = {tuple(r) for r in N.metric_mask(grid, fg, 2, 1).collect()}
    n, kernel = B.metric_mask_kernel(2, 1)
    blocks = B.voxels_to_blocks(grid, *box, chunk, "uint8")
    got = B.blocks_to_voxels(B.with_halo(blocks, (n,) * 3, kernel, box, chunk, dtype="uint8"), "int")
    assert {tuple(r) for r in got.select("z", "y", "x", "v").collect()} == want


def test_map_blocks_and_predict(spark):
    a = volume((4, 6, 6))
    box = ((0, 0, 0), a.shape)
    blocks = B.voxels_to_blocks(voxels(spark, a), *box, (2, 3, 3), "int32")
    assert (back(B.blocks_to_voxels(B.map_blocks(blocks, lambda b: 255 - b)), a.shape) == 255 - a).all()

    def load():
        return lambda b: np.stack([b[1:-1, 1:-1, 1:-1], b[:-2, 1:-1, 1:-1]]).astype(float)

    out = predict.predict_blocks(blocks, load, (4, 5, 5), (2, 3, 3), box, 2)
    assert (back(B.blocks_to_voxels(out.filter(F.col("c") == 0)), a.shape) == a).all()
    assert (back(B.blocks_to_voxels(out.filter(F.col("c") == 1)), a.shape)[1:] == a[:-1]).all()
    assert predict.cover(((0, 5, 9), (3, 4, 5)), (4, 7, 5)) == ([0, 4, 9], [4, 7, 5])


def test_elastic_augment_keeps_constants_and_repeats(spark):
    a = np.full((4, 8, 8), 3)
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (4, 4, 8), "uint8")
    for order in (0, 1):
        got = B.elastic_augment(blocks, 4, 2.0, (0.0, 1.57), 5, order)
        assert (back(B.blocks_to_voxels(got), a.shape) == 3).all()
    b = B.voxels_to_blocks(voxels(spark, volume((4, 8, 8))), (0, 0, 0), a.shape, (4, 4, 8), "uint8")
    runs = [back(B.blocks_to_voxels(B.elastic_augment(b.repartition(k), 4, 1.0, (0.0, 1.0), 9)), a.shape) for k in (1, 3)]
    assert (runs[0] == runs[1]).all()
    still = B.elastic_augment(b, 4, 0.0, (0.0, 0.0), 9, 1)
    assert (back(B.blocks_to_voxels(still), a.shape) == volume((4, 8, 8))).all()
