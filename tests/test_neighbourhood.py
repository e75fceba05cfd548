import numpy as np
import pytest

from voxlake.operators import blocks as B
from voxlake.operators import histogram as H
from voxlake.operators import neighbourhood as N


def table(spark, a, kind="fg"):
    at = np.argwhere(a != 0) if kind == "fg" else np.argwhere(np.ones(a.shape, bool))
    rows = [(*map(int, p), int(a[tuple(p)])) for p in at]
    return spark.createDataFrame(rows, "z long, y long, x long, v long")


def solid(df, shape):
    a = np.zeros(shape, int)
    for r in df.collect():
        a[r.z, r.y, r.x] = 1
    return a


def flood(a, block=None):
    label, seen = np.zeros(a.shape, int), 0
    for start in map(tuple, np.argwhere(a != 0)):
        if label[start]:
            continue
        seen += 1
        todo = [start]
        label[start] = seen
        while todo:
            p = todo.pop()
            for axis in range(3):
                for d in (-1, 1):
                    q = list(p)
                    q[axis] += d
                    q = tuple(q)
                    inside = all(0 <= k < n for k, n in zip(q, a.shape))
                    if inside and a[q] and not label[q] and (block is None or all(i // b == j // b for i, j, b in zip(p, q, block))):
                        label[q] = seen
                        todo.append(q)
    return label


@pytest.mark.parametrize("block,tile", [(None, (32, 32, 32)), (None, (3, 2, 3)), ((3, 3, 3), None)])
def test_components_equal_flood_fill(spark, monkeypatch, block, tile):
    monkeypatch.setattr(N, "TILE", tile)
    a = (np.random.default_rng(1).random((6, 7, 8)) < 0.35).astype(int)
    want = flood(a, block)
    got = {}
    for r in N.label_components(table(spark, a), block).collect():
        got.setdefault(r.component, set()).add((r.z, r.y, r.x))
    assert sorted(map(sorted, got.values())) == sorted(sorted(map(tuple, np.argwhere(want == k))) for k in range(1, want.max() + 1))


def test_small_objects_go_and_small_holes_fill(spark):
    a = (np.random.default_rng(2).random((5, 6, 7)) < 0.4).astype(int)
    label = flood(a)
    sizes = np.bincount(label.ravel())
    want = (sizes[label] >= 5) & (a != 0)
    assert (solid(N.remove_small(table(spark, a), 5), a.shape) == want).all()
    holes = flood(1 - a)
    filled = (a != 0) | (np.bincount(holes.ravel())[holes] < 4)
    assert (solid(N.fill_small(table(spark, a, "all"), table(spark, a), 4), a.shape) == filled).all()


def test_foreground_mask_of_a_box_with_salt_and_pepper(spark):
    a = np.zeros((8, 12, 12), int)
    a[2:7, 2:10, 2:10] = 100
    a[4, 5, 5] = 0
    a[0, 11, 11] = 100
    a[1, 0, 0] = 200
    mask = N.foreground_mask(table(spark, a, "all"), ((0, 0, 0), a.shape), 2, 180, 1, 1, 20)
    got = {(r.z, r.y, r.x): r.mask for r in mask.collect()}
    assert len(got) == a.size and got[4, 5, 5] == 255 and got[4, 6, 6] == 255
    assert got[0, 11, 11] == 0 and got[1, 0, 0] == 0


def test_an_object_counts_with_its_hole(spark):
    """A shell of 26 voxels round one hole is kept at 27."""
    a = np.zeros((5, 5, 5), int)
    a[1:4, 1:4, 1:4] = 100
    a[2, 2, 2] = 0
    mask = N.foreground_mask(table(spark, a, "all"), ((0, 0, 0), a.shape), 2, 180, 0, 0, 27)
    assert {(r.z, r.y, r.x) for r in mask.filter("mask = 255").collect()} == {(z, y, x) for z in (1, 2, 3) for y in (1, 2, 3) for x in (1, 2, 3)}


@pytest.mark.parametrize("sizes", [(1, 1, 20), (2, 1, 8)])
def test_foreground_mask_of_blocks_equals_that_of_voxels(spark, sizes):
    rng = np.random.default_rng(sum(sizes))
    a = np.repeat(np.repeat(np.repeat(rng.integers(0, 3, (3, 5, 4)) * 100, 3, 0), 3, 1), 3, 2)
    a[rng.random(a.shape) < 0.05] = 100
    box = (0, 0, 0), a.shape
    voxels = table(spark, a, "all")
    want = {tuple(r) for r in N.foreground_mask(voxels, box, 2, 180, *sizes).collect()}
    blocks = B.voxels_to_blocks(voxels, *box, (4, 5, 6), "int16")
    got = {tuple(r) for r in B.blocks_to_voxels(N.foreground_mask_blocks(blocks, box, (4, 5, 6), 2, 180, *sizes), "int").collect()}
    assert got == want and len({m for *_, m in got}) == 2


def test_clip_spends_what_is_cut_off():
    assert H.clip_counts(np.array([10, 0, 0, 0]), 4).tolist() == [4, 2, 2, 2]
    assert H.clip_counts(np.array([9, 3, 0, 0]), 4).tolist() == [4, 4, 2, 2]
    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 40, 32)
        out = H.clip_counts(h, 30)
        assert 0 <= out.sum() - h.sum() < 32 and out.max() <= 30  # the last stride may give a few more than was cut off
    assert H.clip_counts(np.array([50, 50]), 4).tolist() == [4, 4]


def test_clahe_range_and_constant(spark):
    a = np.random.default_rng(4).integers(0, 256, (4, 8, 8))
    got = [r.v for r in H.clahe(table(spark, a, "all"), 4, 0.2).collect()]
    assert len(got) == a.size and min(got) >= 0 and max(got) <= 255
    rows = {(r.z, r.y, r.x): r.v for r in H.clahe(table(spark, a, "all"), 4, 0.2).collect()}
    again = {(r.z, r.y, r.x): r.v for r in H.clahe(table(spark, a, "all").repartition(7), 4, 0.2).collect()}
    assert rows == again


def equalised(image, kernel, clip, nbins=256):
    """The whole image at once: its rim of half a kernel filled, then mirrored to full tiles."""
    half = kernel // 2
    grey = np.rint(np.pad(image, half, constant_values=int(image.mean())) / 255 * (H.GREY - 1)).astype(int)
    grey = np.pad(grey, [(0, -n % kernel) for n in grey.shape], mode="reflect") // H.bin_size(nbins)
    maps = {}
    for t in np.ndindex(*[n // kernel for n in grey.shape]):
        counts = np.bincount(grey[tuple(slice(i * kernel, (i + 1) * kernel) for i in t)].ravel(), minlength=nbins)
        upto = np.cumsum(H.clip_counts(counts, max(1, int(clip * kernel**3)) if clip else kernel**3))
        maps[t] = np.minimum(np.floor(upto * ((H.GREY - 1) / kernel**3)), H.GREY - 1)
    top = np.array([n // kernel for n in grey.shape]) - 1
    out = np.zeros(image.shape, int)
    for p in np.ndindex(*image.shape):
        at = np.array(p) - kernel % 2
        v = 0.0
        for up in np.ndindex(2, 2, 2):
            share = np.prod(np.where(np.array(up) == 1, at % kernel / kernel, 1 - at % kernel / kernel))
            v += share * maps[tuple(np.clip(at // kernel + up, 0, top))][grey[tuple(np.array(p) + half)]]
        out[p] = int(int(v + 1e-9) / (H.GREY - 1) * 255)
    return out


@pytest.mark.parametrize("kernel,clip,shape", [(4, 0.02, (8, 8, 8)), (4, 0.3, (5, 6, 7)), (3, 0.1, (7, 4, 6)), (6, 0.0, (6, 9, 7))])
def test_clahe_equals_a_plain_version(spark, kernel, clip, shape):
    a = np.random.default_rng(kernel).integers(40, 200, shape)
    want = equalised(a, kernel, clip)
    got = np.zeros(shape, int)
    for r in H.clahe(table(spark, a, "all"), kernel, clip).collect():
        got[r.z, r.y, r.x] = r.v
    assert np.abs(got - want).max() <= 1 and (got != want).mean() < 0.01


def test_clahe_of_a_box_looks_half_a_kernel_round_it(spark):
    a = np.random.default_rng(1).integers(0, 256, (12, 12, 12))
    whole = {(r.z, r.y, r.x): r.v for r in H.clahe(table(spark, a, "all"), 4, 0.1).collect()}
    part = {(r.z, r.y, r.x): r.v for r in H.clahe(table(spark, a, "all"), 4, 0.1, box=((4, 4, 4), (4, 4, 4))).collect()}
    assert len(part) == 64 and all(whole[p] == v for p, v in part.items())
    assert H.clahe(table(spark, a, "all").filter("false"), 4).count() == 0


def test_metric_mask_equals_dilation_without_erosion(spark):
    a = (np.random.default_rng(3).random((6, 9, 8)) < 0.7).astype(int)
    for out, inw in ((2, 1), (1, 2), (0, 1)):
        mask = N.metric_mask(table(spark, a, "all"), table(spark, a), out, inw)
        wide, narrow = solid(N.dilate(table(spark, a), out, ((0, 0, 0), a.shape)), a.shape), solid(N.erode(table(spark, a), inw), a.shape)
        got = np.ones(a.shape, int)
        for r in mask.collect():
            got[r.z, r.y, r.x] = r.mask
        assert ((got == 0) == ((wide == 1) & (narrow == 0))).all()
