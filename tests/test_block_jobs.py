"""Components, equalisation and sweeps of checkpoints on blocks."""

import os
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from tests.test_blocks import back, volume, voxels
from tests.test_neighbourhood import equalised, flood
from voxlake.functions.scratch import names, shared_dir
from voxlake.operators import block_components as C
from voxlake.operators import block_contrast as E
from voxlake.operators import blocks as B
from voxlake.operators import histogram as H
from voxlake.operators import predict
from voxlake.plans import jobs

SF = "/root/testdata/sf0.001"


def same_parts(a, b):
    """Two labellings with the same parts."""
    return len({*zip(a.ravel().tolist(), b.ravel().tolist())}) == len({*a.ravel().tolist()}) == len({*b.ravel().tolist()})


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([0.2, 0.4, 0.6, 0.9, 0.0, 1.0]), st.tuples(*[st.integers(1, 7)] * 3))
def test_labels_of_a_chunk_equal_flood_fill(seed, share, shape):
    a = np.random.default_rng(seed).random(shape) < share
    labels, sizes = C.label_block(a)
    assert same_parts(labels, flood(a.astype(int))) and ((labels > 0) == a).all()
    assert sizes.tolist() == [int((labels == k + 1).sum()) for k in range(len(sizes))]


@pytest.mark.parametrize("chunk", [(6, 9, 7), (2, 4, 3), (1, 1, 2), (4, 9, 1)])
@pytest.mark.parametrize("holes", [False, True])
def test_small_components_of_blocks_equal_flood_fill(spark, chunk, holes):
    a = (np.random.default_rng(7).random((6, 9, 7)) < 0.45).astype(int)
    label = flood(1 - a if holes else a)
    sizes = np.bincount(label.ravel())
    if holes:
        want = ~((sizes[label] >= 6) & (a == 0))
    else:
        want = (sizes[label] >= 6) & (a != 0)
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, "uint8")
    before = set(names(spark, shared_dir(spark)))
    got = C.remove_small_blocks(blocks, 6, ((0, 0, 0), a.shape), chunk, holes=holes)
    assert (back(B.blocks_to_voxels(got), a.shape) == want).all()
    assert [n.split("-")[0] for n in set(names(spark, shared_dir(spark))) - before] == ["sized"]  # scratch tables are gone


def test_components_of_single_chunks(spark):
    a = (np.random.default_rng(8).random((6, 8, 6)) < 0.5).astype(int)
    label = flood(a, (3, 4, 3))
    want = (np.bincount(label.ravel())[label] >= 4) & (a != 0)
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (3, 4, 3), "uint8")
    assert (back(B.blocks_to_voxels(C.remove_small_blocks(blocks, 4, ((0, 0, 0), a.shape), (3, 4, 3), across=False)), a.shape) == want).all()


def test_only_faces_numbers_and_chunks_shuffle(spark):
    """A thread through all chunks is one component; absent chunks break it."""
    a = np.zeros((4, 4, 40), int)
    a[1, 1] = 1
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (4, 4, 4), "uint8")
    assert B.blocks_to_voxels(C.remove_small_blocks(blocks, 40, ((0, 0, 0), a.shape), (4, 4, 4)), skip=0).count() == 40
    assert B.blocks_to_voxels(C.remove_small_blocks(blocks, 41, ((0, 0, 0), a.shape), (4, 4, 4)), skip=0).count() == 0
    assert B.blocks_to_voxels(C.remove_small_blocks(blocks.filter("cx != 5"), 20, ((0, 0, 0), a.shape), (4, 4, 4)), skip=0).count() == 20
    labelled = C.label_blocks(blocks, ((0, 0, 0), a.shape), (4, 4, 4))
    assert C.face_edges(labelled).count() == 9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize(("one", "other"), [("nbh_08_remove_small", "nbh_08_remove_small_blocks"), ("nbh_09_foreground_mask", "nbh_09_foreground_mask_blocks"), ("his_05_clahe", "his_05_clahe_blocks")])
def test_block_queries_equal_those_of_voxels(spark, one, other):
    q = __spark_entry__.queries()
    a, b = q[one](spark, SF), q[other](spark, SF)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect())) != []


@pytest.mark.parametrize(("kernel", "clip", "shape", "chunk"), [(4, 0.02, (8, 8, 8), (4, 4, 4)), (4, 0.3, (5, 6, 7), (2, 3, 7)), (3, 0.1, (7, 4, 6), (8, 8, 8)), (6, 0.0, (6, 9, 7), (5, 2, 3)), (8, 0.05, (9, 20, 11), (3, 3, 3))])
def test_equalised_blocks_equal_a_plain_version(spark, kernel, clip, shape, chunk):
    a = np.random.default_rng(kernel).integers(40, 200, shape)
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, "uint8")
    got = back(B.blocks_to_voxels(E.clahe_blocks(blocks, ((0, 0, 0), shape), chunk, kernel, clip)), shape)
    want = equalised(a, kernel, clip)
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01


def test_a_box_inside_the_blocks_looks_half_a_kernel_round_it(spark):
    a = np.random.default_rng(1).integers(0, 256, (12, 12, 12))
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (5, 4, 7), "uint8")
    whole = back(B.blocks_to_voxels(E.clahe_blocks(blocks, ((0, 0, 0), a.shape), (5, 4, 7), 4, 0.1)), a.shape)
    part = E.clahe_blocks(blocks, ((4, 4, 4), (4, 4, 4)), (5, 4, 7), 4, 0.1, origin=(0, 0, 0))
    assert (back(B.blocks_to_voxels(part), a.shape)[4:8, 4:8, 4:8] == whole[4:8, 4:8, 4:8]).all() and B.blocks_to_voxels(part).count() == 64


def test_equalising_reads_the_chunks_twice(spark):
    blocks = B.voxels_to_blocks(voxels(spark, volume()), (0, 0, 0), (6, 9, 7), (2, 3, 4), "uint8")
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    counted = blocks.mapInPandas(look, B.SCHEMA)
    E.clahe_blocks(counted, ((0, 0, 0), (6, 9, 7)), (2, 3, 4), 3, 0.1).count()
    assert seen.value == 2 * 3 * 3 * 2
    assert H.clahe(voxels(spark, volume()).filter("false"), 4).count() == 0


def plus(k, folder=None):
    def load():
        if folder:
            Path(folder, f"{k}-{os.getpid()}-{os.urandom(4).hex()}").touch()
        return lambda a: np.stack([a[1:-1, 1:-1, 1:-1] * 0.0 + 2.5, a[1:-1, 1:-1, 1:-1] + a[2:, 1:-1, 1:-1] + k])

    return load


def test_sweep_exchanges_halos_once_and_loads_a_model_once_a_worker(spark, tmp_path):
    a = volume((6, 9, 7))
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (2, 3, 4), "int16")
    mask = B.voxels_to_blocks(voxels(spark, a % 2), (0, 0, 0), a.shape, (2, 3, 4), "uint8")
    models = {k: plus(k, str(tmp_path)) for k in predict.iterations(0, 4, 2)}
    box = (0, 0, 0), a.shape
    rows = predict.prediction_sweep(blocks, models, (4, 5, 6), (2, 3, 4), box)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # of the voxels into chunks, and of the halos
    path = f"file://{tmp_path}/out"
    got = jobs.predict_sweep_arrays(blocks, models, (4, 5, 6), (2, 3, 4), box, path, "r", mask)
    loads = Counter(f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir() if f.name[0].isdigit())
    assert loads and max(loads.values()) == 1
    assert sorted(d.name for d in (tmp_path / "out").iterdir() if d.is_dir()) == [f"dataset=predictions%2Fr%2Fiteration_{k:06d}" for k in (0, 2, 4)]
    up = np.concatenate([a[1:], np.zeros((1, 9, 7))])
    scores = {k: [np.full(a.shape, 2.5), a + up + k] for k in models}
    for k in models:
        seg = back(B.blocks_to_voxels(got.filter(f"iteration = {k} AND array = 'segmentation'")), a.shape)
        assert (seg == (scores[k][1] > scores[k][0]) * (a % 2)).all()
        p = back(B.blocks_to_voxels(got.filter(f"iteration = {k} AND array = 'prob_maps/class_1'")), a.shape)
        assert np.allclose(p, 1 / (1 + np.exp(scores[k][0] - scores[k][1])), atol=1e-6)
    with pytest.raises(ValueError, match="no iteration"):
        predict.prediction_sweep(blocks, {}, (4, 5, 6), (2, 3, 4), box)


def test_prediction_loads_a_model_once_a_worker(spark, tmp_path):
    a = volume((6, 9, 7))
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, (1, 2, 2), "int16")
    for _ in range(2):
        assert predict.predict_blocks(blocks, plus(1, str(tmp_path)), (3, 4, 4), (1, 2, 2), ((0, 0, 0), a.shape), 2).count() > 100
    loads = Counter(f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir())
    assert loads and max(loads.values()) == 1


def test_a_worker_holds_a_bounded_number_of_models():
    predict._LOADED.clear()
    made = []
    for k in (1, 2, 1, 3, 1, 2):
        predict.held_model(f"m{k}", lambda k=k: made.append(k), most=2)
    assert made == [1, 2, 3, 2] and len(predict._LOADED) == 2
