import warnings
from pathlib import Path

import numpy as np
import pytest

from tests.test_blocks import back, volume, voxels
from voxlake.operators import blocks as B
from voxlake.sources import arrays as A

BOX = ((0, 0, 0), (6, 9, 7))


def as_blocks(spark, a, chunk):
    return B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, chunk, "int32")


def files(root, write):
    return {p: (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(root).rglob("*.parquet") if f"write={write:010d}" in str(p)}


def dense(spark, path, box=None):
    return back(B.blocks_to_voxels(A.read_array(spark, path, "d", "a/b", box)), (6, 9, 7))


def test_boxes_one_after_another_equal_assignments(spark, tmp_path):
    path, rng = f"file://{tmp_path}/t", np.random.default_rng(1)
    want = np.zeros(BOX[1])
    layout = A.Layout(*BOX, (2, 4, 3), "int16")
    boxes = [((0, 0, 0), (4, 5, 7)), ((3, 3, 2), (3, 6, 3)), ((-5, 4, 1), (20, 1, 1)), ((1, 1, 1), (1, 1, 1)), ((0, 0, 0), (6, 9, 7))]
    for k, (o, s) in enumerate(boxes):
        a = rng.integers(1, 100, BOX[1])
        assert A.update_blocks(as_blocks(spark, a, [(3, 3, 3), (6, 9, 7), (1, 2, 7)][k % 3]), path, "d", "a/b", (o, s), layout) > 0
        at = tuple(slice(max(0, p), p + n) for p, n in zip(o, s))
        want[at] = a[at]
        assert (dense(spark, path) == want).all()
    assert len(A.state(spark, path, "d", "a/b").writes) == 1  # the last one covers all before
    assert A.read_array(spark, path, "d", "a/b").first().dtype == "int16"


def test_only_touched_chunks_are_written_and_files_of_others_stay(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = volume() + 1
    A.update_blocks(as_blocks(spark, a, (2, 4, 3)), path, "d", "a/b")
    before = files(tmp_path, 1)
    assert A.update_blocks(as_blocks(spark, a * 10, (2, 4, 3)), path, "d", "a/b", ((1, 0, 0), (2, 4, 3))) == 2
    assert before and files(tmp_path, 1) == before
    written = spark.read.parquet(f"{A.folder(path, 'd', 'a/b')}/{A.state(spark, path, 'd', 'a/b').writes[1][1]}")
    assert {(r.cz, r.cy, r.cx) for r in written.collect()} == {(0, 0, 0), (1, 0, 0)}
    want = a.copy()
    want[1:3, :4, :3] *= 10
    assert (dense(spark, path) == want).all()
    part = A.read_array(spark, path, "d", "a/b", ((0, 8, 0), (1, 1, 1)))
    assert {(r.cz, r.cy, r.cx) for r in part.collect()} == {(0, 2, 0)}
    assert "Exchange" not in A.read_array(spark, path, "d", "a/b")._jdf.queryExecution().toString()
    A.compact(spark, path, "d", "a/b")
    A.vacuum(spark, path, "d", "a/b")
    assert not files(tmp_path, 1) and not files(tmp_path, 2) and files(tmp_path, 3)
    assert (dense(spark, path) == want).all()


def test_boxes_outside_and_writes_without_blocks_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    a = volume() + 1
    b = as_blocks(spark, a, (2, 4, 3))
    with pytest.raises(ValueError, match="no array"):
        A.read_array(spark, path, "d", "a/b")
    assert A.update_blocks(b.filter("false"), path, "d", "a/b") == 0
    A.update_blocks(b, path, "d", "a/b")
    with pytest.warns(UserWarning, match="outside"):
        assert A.update_blocks(b, path, "d", "a/b", ((50, 0, 0), (2, 2, 2))) == 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert A.update_blocks(b.filter("cz > 90"), path, "d", "a/b", ((0, 0, 0), (2, 2, 2))) == 0
    assert A.state(spark, path, "d", "a/b").last == 1 and (dense(spark, path) == a).all()


def test_a_write_that_fails_or_comes_second_leaves_the_array(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    a = volume() + 1
    b = as_blocks(spark, a, (2, 4, 3))
    A.update_blocks(b, path, "d", "a/b")
    bad = b.selectExpr(*[c for c in b.columns if c != "data"], "substring(data, 1, 3) AS data")
    with pytest.raises(Exception, match="buffer|reshape"):
        A.update_blocks(bad, path, "d", "a/b", BOX)
    assert (dense(spark, path) == a).all()
    old = A.state(spark, path, "d", "a/b")
    A.update_blocks(as_blocks(spark, a * 2, (2, 4, 3)), path, "d", "a/b", ((0, 0, 0), (2, 2, 2)))
    monkeypatch.setattr(A, "state", lambda *_: old)
    with pytest.raises(A.ConcurrentWrite):
        A.update_blocks(as_blocks(spark, a * 3, (2, 4, 3)), path, "d", "a/b", ((4, 4, 4), (2, 2, 2)))
    monkeypatch.undo()
    want = a.copy()
    want[:2, :2, :2] *= 2
    assert (dense(spark, path) == want).all()
