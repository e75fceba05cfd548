import numpy as np
import pytest

from tests.test_blocks import back, volume, voxels
from voxlake.operators import blocks as B
from voxlake.operators import deform as D
from voxlake.operators import project

SHAPE = (9, 20, 17)
STRONG = D.Deformation((4, 8, 8), (1.0, 2.0, 2.0), (0.2, 1.5), 0.3, 2, 2, 5)


def deformed(spark, a, how, chunk, order=0, kind="int32"):
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, kind)
    return back(B.blocks_to_voxels(D.deform_blocks(blocks, ((0, 0, 0), a.shape), chunk, how, order)), a.shape)


@pytest.mark.parametrize("order", [0, 1])
def test_the_result_does_not_depend_on_the_chunks(spark, order):
    a = np.random.default_rng(2).integers(0, 250, SHAPE)
    whole = B.gather(a, D.source_places(STRONG, (0, 0, 0), SHAPE, ((0, 0, 0), SHAPE)), order)
    assert (whole != a).mean() > 0.5
    for chunk in ((9, 20, 17), (4, 7, 5), (3, 20, 2)):
        assert (deformed(spark, a, STRONG, chunk, order) == whole).all()


def test_labels_stay_a_subset_and_constants_stay(spark):
    a = volume(SHAPE) * 7
    assert set(np.unique(deformed(spark, a, STRONG, (4, 7, 5)))) <= set(np.unique(a))
    assert (deformed(spark, np.full(SHAPE, 3), STRONG, (4, 7, 5), 1) == 3).all()


def test_nothing_moves_without_a_cause(spark):
    a = volume(SHAPE)
    still = D.Deformation((8, 8, 8), (0, 0, 0), (0.0, 0.0), 0.0, 0, 4, 1)
    assert (deformed(spark, a, still, (4, 7, 5), 1) == a).all()


def test_a_quarter_turn_is_a_rotated_array(spark):
    a = np.random.default_rng(1).integers(1, 99, (3, 11, 11))
    turn = D.Deformation((8, 8, 8), (0, 0, 0), (np.pi / 2, np.pi / 2), 0.0, 0, 4, 1)
    assert (deformed(spark, a, turn, (2, 4, 3)) == np.rot90(a, 1, (1, 2))).all() or (deformed(spark, a, turn, (2, 4, 3)) == np.rot90(a, -1, (1, 2))).all()


def test_sections_shift_with_all_that_follow():
    how = D.Deformation((8, 8, 8), (0, 0, 0), (0.0, 0.0), 0.05, 2, 4, 3)
    moved = how.shifts(0, 4000)
    steps = np.diff(moved, axis=0)
    assert 0.03 < (steps != 0).any(1).mean() < 0.06 and np.abs(steps).max() == 2
    places = D.source_places(how, (100, 0, 0), (5, 4, 4), ((0, 0, 0), (4000, 9999, 9999)))
    assert np.allclose(places[1][:, 2, 0], np.clip(moved[100:105, 0] + 2, 0, 9998)) and np.allclose(places[0][:, 0, 0], range(100, 105))


@pytest.mark.parametrize("step", [1, 2, 4])
def test_the_subsampled_field_is_the_field(step):
    """Where control points lie on multiples of the step, linear interpolation loses nothing."""
    box = ((0, 0, 0), (16, 16, 16))
    how = [D.Deformation((8, 8, 8), (1, 1, 1), (0.5, 0.5), 0.0, 0, s, 9) for s in (1, step)]
    assert np.allclose(*[D.source_places(h, (3, 2, 5), (7, 9, 8), box) for h in how])


def test_moves_are_normal_draws_of_their_own_place():
    how = D.Deformation(sigma=(2.0, 2.0, 2.0), seed=4)
    one = how.moves([np.arange(20)] * 3, 1)
    assert abs(one.mean()) < 0.1 and 1.85 < one.std() < 2.05 and np.abs(one).max() <= 6
    assert (how.moves([np.arange(5, 9), np.arange(3, 7), np.arange(2, 4)], 1) == one[5:9, 3:7, 2:4]).all()
    assert abs(np.corrcoef(one[1:].ravel(), one[:-1].ravel())[0, 1]) < 0.05


def test_draws_are_those_of_columns(spark):
    got = [r[0] for r in spark.range(50).select(project.draw(9, "id", "id")).collect()]
    assert np.allclose(got, D.draws(9, np.arange(50), np.arange(50)), atol=0)
