from pathlib import Path

import numpy as np
import pytest

from tests.test_blocks import back, volume, voxels
from voxlake.operators import blocks as B
from voxlake.sources import chunk_source as S
from voxlake.sources import chunks

CHUNK = (2, 4, 3)


def write(spark, root, a, blocks=None, mode="append", **more):
    S.register(spark)
    blocks = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, CHUNK, "int16") if blocks is None else blocks
    options = {"path": f"file://{root}/c.zarr", "array": "volumes/raw", "shape": ",".join(map(str, a.shape)), "chunk": "2,4,3", "dtype": "int16", "offset": "0,8,16", "resolution": "4,4,4"}
    blocks.write.format("chunks").options(**options, **more).mode(mode).save()
    return options


def load(spark, options, **more):
    return spark.read.format("chunks").options(path=options["path"], array=options["array"], **more).load()


def test_round_trip_and_the_other_reader(spark, tmp_path):
    a = volume()
    options = write(spark, tmp_path, a)
    assert (back(B.blocks_to_voxels(load(spark, options)), a.shape) == a).all()
    spec = chunks.scan_catalog(spark, options["path"]).first().asDict()
    assert spec["offset_nm"] == [0, 8, 16] and spec["chunk"] == [2, 4, 3] and spec["dtype"] == "int16"
    assert (back(B.blocks_to_voxels(chunks.read_blocks(spark, options["path"], spec["array"], spec)), a.shape) == a).all()
    with pytest.raises(Exception, match="is there"):
        write(spark, tmp_path, a)
    write(spark, tmp_path, a * 2, mode="overwrite")
    assert (back(B.blocks_to_voxels(load(spark, options)), a.shape) == a * 2).all()


def test_only_chunks_that_the_filter_allows_are_opened(spark, tmp_path):
    a = volume()
    options = write(spark, tmp_path, a)
    folder = Path(tmp_path, "c.zarr", "volumes", "raw")
    met = {f"{z}.{y}.{x}" for z in (1,) for y in (1, 2) for x in (0, 2)}
    for f in folder.iterdir():
        if f.name[0].isdigit() and f.name not in met:
            f.write_bytes(b"broken")  # whoever opens it fails
    rows = load(spark, options, chunks_per_task=3).filter("cz = 1 AND cy > 0 AND cx IN (0, 2)")
    assert {f"{r.cz}.{r.cy}.{r.cx}" for r in rows.collect()} == met
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "= 1" not in plan and "IN (" not in plan  # Spark doesn't check again what the source took
    assert rows.rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="incorrect header|Error -3"):
        load(spark, options).collect()
    assert load(spark, options).filter("cz > 90").count() == 0


def test_chunks_without_a_file(spark, tmp_path):
    a = volume() + 1
    options = write(spark, tmp_path, a)
    Path(tmp_path, "c.zarr", "volumes", "raw", "0.0.0").unlink()
    want = a.copy()
    want[:2, :4, :3] = 0
    assert (back(B.blocks_to_voxels(load(spark, options)), a.shape) == want).all()
    assert load(spark, options).count() == load(spark, options, absent="skip").count() + 1


def test_an_aborted_write_leaves_no_array(spark, tmp_path):
    a = volume()
    good = B.voxels_to_blocks(voxels(spark, a), (0, 0, 0), a.shape, CHUNK, "int16")
    bad = good.selectExpr(*[c if c != "data" else "IF(cz = 2, substring(data, 1, 3), data) AS data" for c in good.columns])
    with pytest.raises(Exception, match="buffer size|reshape"):
        write(spark, tmp_path, a, bad)
    assert not list(Path(tmp_path).rglob(".zarray")) and not Path(tmp_path, "c.zarr", "volumes", "raw").exists()
    options = write(spark, tmp_path, a)
    with pytest.raises(Exception, match="buffer size|reshape"):
        write(spark, tmp_path, a, bad, "overwrite")
    assert list(Path(tmp_path).rglob(".zarray")) and (np.array(back(B.blocks_to_voxels(load(spark, options)), a.shape)) == a).all()
