import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import blocks as B
from voxlake.sources import chunks, configs, sections
from voxlake.streaming import append_log


def volume():
    return np.random.default_rng(0).integers(0, 255, (5, 6, 7)).astype(np.uint8)


def as_blocks(spark, a, chunk):
    rows = []
    for c in chunks.chunk_numbers(a.shape, chunk):
        lo = [i * k for i, k in zip(c, chunk)]
        rows.append(B._row(c, lo, a[tuple(slice(o, o + k) for o, k in zip(lo, chunk))], str(a.dtype)))
    return spark.createDataFrame(rows, B.SCHEMA)


def dense(df, shape):
    a = np.zeros(shape, int)
    for r in B.blocks_to_voxels(df, "int").collect():
        a[r.z, r.y, r.x] = r.v
    return a


def test_export_catalog_and_read_back(spark, tmp_path):
    a, chunk = volume(), (2, 4, 4)
    root = f"file://{tmp_path}/cell.zarr"
    blocks = as_blocks(spark, a, chunk).filter("NOT (cz = 1 AND cy = 0 AND cx = 0)")
    chunks.export_blocks(blocks, root, "volumes/raw", a.shape, chunk, "uint8", (0, 4, 8), (4, 4, 4))
    spec = chunks.scan_catalog(spark, root).first().asDict()
    assert spec["array"] == "volumes/raw" and spec["shape_vox"] == [5, 6, 7] and spec["dtype"] == "uint8" and spec["offset_nm"] == [0, 4, 8] and spec["compressor"] == "zlib"
    got = chunks.read_blocks(spark, root, "volumes/raw", spec)
    assert got.count() == 11
    full = chunks.fill_missing(got, a.shape, chunk, "uint8", 0)
    want = a.copy()
    want[2:4, :4, :4] = 0
    assert (dense(full, a.shape) == want).all()
    part = chunks.read_blocks(spark, root, "volumes/raw", spec, ((0, 0, 0), (2, 4, 5)))
    assert part.count() == 2
    container, array = spark.range(1).select(*[c.alias(n) for c, n in zip(chunks.split_path(F.lit("/d/cell.zarr/volumes/raw")), "ca")]).first()
    assert (container, array) == ("/d/cell.zarr", "volumes/raw")


def test_write_clips_to_the_box(spark, tmp_path):
    a = volume()
    path = f"file://{tmp_path}/t"
    blocks = as_blocks(spark, a, (2, 3, 7))
    assert chunks.write_blocks(blocks, path, "d", "raw", ((1, 0, 2), (3, 6, 3)), "uint16") == 4
    assert chunks.write_blocks(blocks, path, "d", "other") == 6
    got = spark.read.parquet(path).filter("array = 'raw'")
    want = np.zeros(a.shape, int)
    want[1:4, :, 2:5] = a[1:4, :, 2:5]
    assert (dense(got, a.shape) == want).all() and got.first().dtype == "uint16"
    assert (dense(chunks.empty_blocks(spark, (3, 3, 3), (2, 2, 2), "uint8", 7), (3, 3, 3)) == 7).all()


CONFIG = {"cell_1": {"file": "a.zarr", "offset": [1, 2, 3], "shape": [4, 5, 6], "voxel_size": [5, 5, 5], "raw": "volumes/raw", "labels": {"volumes/labels/mito": 1}, "mask": "volumes/mask", "metric_masks": ["m"]}}


def test_configs(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    df = configs.read_configs(spark, f"file://{tmp_path}/c.json", "/data")
    row = df.first()
    assert row.nickname == "CELL_1" and row.file == "/data/a.zarr" and row.offset == [1, 2, 3] and row["mask"] == "volumes/mask"
    assert tuple(configs.labels_of(df).first()) == ("CELL_1", "volumes/labels/mito", 1)
    with pytest.raises(ValueError):
        configs.union_configs([df, df])


def test_configs_from_catalog(spark):
    spec = spark.createDataFrame(
        [("crop1", "mito", "a.zarr", "volumes/x/mito", [4, 5, 6], [8.0, 4.0, 0.0], [4.0, 4.0, 4.0]), ("crop1", "np", "a.zarr", "volumes/x/np", [4, 5, 6], [8.0, 4.0, 0.0], [4.0, 4.0, 4.0])],
        "crop string, organelle string, file string, array string, shape_vox array<bigint>, offset_nm array<double>, voxel_size_nm array<double>",
    )
    got = {r.organelle: json.loads(r.json) for r in configs.configs_from_catalog(spec, {"mito": 1, "np": 2}).collect()}
    assert got["mito"]["crop1_mito"]["offset"] == [2, 1, 0] and got["mito"]["crop1_mito"]["metric_masks"] == ["volumes/metric_masks/mito"]
    assert "metric_masks" not in got["np"]["crop1_np"] and got["np"]["crop1_np"]["labels"] == {"volumes/x/np": 2}


def tiff(path, a):
    """An uncompressed 8-bit grey TIFF."""
    h, w = a.shape
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, h), (279, 4, h * w)]
    body = a.tobytes() + b"\0" * (a.size % 2)
    ifd = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    path.write_bytes(b"II*\0" + struct.pack("<I", 8 + len(body)) + body + ifd)


def test_sections_to_blocks_and_back(spark, tmp_path):
    a = volume()
    for z in range(5):
        tiff(tmp_path / f"s_{z + 8}.tif", a[z])
    found = sections.scan_sections(spark, f"file://{tmp_path}")
    blocks = sections.sections_to_blocks(found, (1, 0, 1), (4, 6, 5), (2, 4, 3), invert=True)
    cut = 255 - a[1:5, 0:6, 1:6]
    assert (dense(blocks, cut.shape) == cut).all()
    planes = {r.name: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) for r in sections.blocks_to_sections(blocks).collect()}
    assert sorted(planes) == [f"section_{z:04d}" for z in range(4)] and all((planes[f"section_{z:04d}"] == cut[z]).all() for z in range(4))
    with pytest.raises(ValueError):
        sections.sections_to_blocks(found, (0, 0, 0), (6, 6, 7), (2, 2, 2))
    (tmp_path / "s_13.tif").write_bytes(b"junk")
    bad = sections.verify_sections(sections.scan_sections(spark, f"file://{tmp_path}").drop("x"))
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["s_13.tif"]
    tiff(tmp_path / "s_20.tif", a[0])
    with pytest.raises(ValueError):
        sections.scan_sections(spark, f"file://{tmp_path}")


def test_section_files_are_written_strip_by_strip(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 255, (5, 23, 17)).astype(np.uint8)
    a[2:4] = 0  # a layer without a chunk
    a[4, 4:20] = 0
    blocks = as_blocks(spark, a, (2, 4, 5)).filter("cz != 1 AND NOT (cz = 2 AND cy BETWEEN 1 AND 4)")
    folder = f"file://{tmp_path}/sections"
    assert sections.export_sections(blocks, folder) == 5
    found = {r.number: r for r in sections.scan_sections(spark, folder).collect()}
    assert sorted(found) == [0, 1, 2, 3, 4]
    for z, r in found.items():
        assert r.nChannels == 1 and (np.frombuffer(r.data, np.uint8).reshape(r.height, r.width) == a[z]).all()
    strips, shape = sections.blocks_to_strips(blocks)
    assert shape == (5, 23, 17) and max(r.height for r in strips.collect()) == 4
    assert not [p for p in (tmp_path / "sections").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]
    sections.spoil(spark.createDataFrame([("section_0003.tif",)], "name string"), folder)
    assert [r.path.rsplit("/", 1)[1] for r in sections.verify_sections(sections.scan_sections(spark, folder)).collect()] == ["section_0003.tif"]
    assert sections.export_sections(blocks.filter("false"), f"file://{tmp_path}/none") == 0 and sections.blocks_to_sections(blocks.filter("false")).count() == 0


def test_import_volumes(spark):
    raw = spark.createDataFrame([(z, y, 0, 256 * (z + y)) for z in range(2) for y in range(4)], "z long, y long, x long, v long")
    got = chunks.import_volumes({"a/raw": raw, "b/groundtruth/c1": raw}, [("a/raw", "volumes/raw"), ("b/groundtruth/c1", "volumes/gt/c1")])
    rows = {(r.array, r.z, r.y): r.v for r in got.collect()}
    assert rows["volumes/raw", 1, 3] == 4 and rows["volumes/gt/c1", 0, 1] == 0 and rows["volumes/gt/c1", 0, 0] == 512
    assert chunks.crop_targets(["x/gt/0003/Crop1/labels/all", "x/raw"], "gt/0003", "labels/all", "volumes/gt") == [("x/gt/0003/Crop1/labels/all", "volumes/gt/Crop1")]


def test_log_stream_appends_once(spark, tmp_path):
    log = spark.createDataFrame([(1, "loss", s, s / 10) for s in range(20)], "run_id long, metric string, step long, value double")
    log.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        append_log(stream, f"{tmp_path}/out", f"{tmp_path}/ck", 5).awaitTermination()
    assert sorted(r.step for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 5, 10, 15]
