"""Round trips of sources and sinks: what a view holds is written to the shared folder, read back and compared with the view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import scratch_path, uri
from ..operators import blocks as B
from ..sources import arrays, chunk_source, chunks, configs, sections
from .registry import query

HEIGHT = "(SELECT max(y) + 1 FROM vox)"
CHUNK = (4, 64, 64)


def _box(t) -> tuple:
    return (0, 0, 0), (7, t.vox.agg(F.max("y")).first()[0] + 1, 100)


def _raw_blocks(t) -> DataFrame:
    return B.voxels_to_blocks(t.vox, *_box(t), CHUNK, "int32", value="raw")


def _exported(t) -> str:
    """The root of an array volumes/raw of the view's raw values, at 0, 8, 16 nm and 4 nm a voxel."""
    root = scratch_path(t.spark, "cell") + ".zarr"
    chunks.export_blocks(_raw_blocks(t), root, "volumes/raw", _box(t)[1], CHUNK, "int32", (0, 8, 16), (4, 4, 4))
    return root


@query("src_01_catalog_scan", "vox", f"""SELECT 'volumes/raw' AS "array", 'int32' AS dtype, 'zlib' AS compressor, '7,' || {HEIGHT} || ',100' AS shape, '4,64,64' AS chunk, 16.0 AS x_nm, 4.0 AS voxel_nm FROM (SELECT 1)""")
def _(t):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    found = chunks.scan_catalog(t.spark, _exported(t))
    return found.select("array", "dtype", "compressor", joined("shape_vox").alias("shape"), joined("chunk").alias("chunk"), F.col("offset_nm")[2].alias("x_nm"), F.col("voxel_size_nm")[2].alias("voxel_nm"))


def _read_back(t, box=None) -> DataFrame:
    root = _exported(t)
    spec = chunks.scan_catalog(t.spark, root).first().asDict()
    return chunks.read_blocks(t.spark, root, spec["array"], spec, box)


@query("src_02_chunk_scan", "vox", f"SELECT z, y, x, raw AS v FROM vox WHERE z < 4 AND y >= 64 * ({HEIGHT} // 128)")
def _(t):
    first = 64 * (_box(t)[1][1] // 128)
    got = _read_back(t, ((0, first, 0), (4, _box(t)[1][1] - first, 100)))
    return B.blocks_to_voxels(got, "int", skip=0)


@query("snk_03_chunk_export", "vox", "SELECT z, y, x, raw AS v FROM vox")
def _(t):
    return B.blocks_to_voxels(_read_back(t), "int", skip=0)


@query("src_02_chunk_source", "vox", f"SELECT z, y, x, raw AS v FROM vox WHERE z < 4 AND y >= 64 * ({HEIGHT} // 128)")
def _(t):
    chunk_source.register(t.spark)
    box = _box(t)
    text = lambda v: ",".join(map(str, v))
    where = {"path": uri(t.spark, scratch_path(t.spark, "cell")) + ".zarr", "array": "volumes/raw"}
    _raw_blocks(t).write.format("chunks").options(**where, shape=text(box[1]), chunk=text(CHUNK), dtype="int32", offset="0,8,16", resolution="4,4,4").mode("append").save()
    got = t.spark.read.format("chunks").options(**where).load().filter((F.col("cz") < 1) & (F.col("cy") >= box[1][1] // 128))
    return B.blocks_to_voxels(got, "int", skip=0)


@query("snk_01_block_sink", "vox", f"SELECT z, y, x, raw AS v FROM vox WHERE z >= 1 AND z < 6 AND y >= 2 AND y < {HEIGHT} - 2 AND x >= 3 AND x < 97")
def _(t):
    path = scratch_path(t.spark, "arrays")
    offset, shape = _box(t)
    chunks.write_blocks(_raw_blocks(t), path, "cell", "raw", ((1, 2, 3), (5, shape[1] - 4, 94)), "uint16")
    return B.blocks_to_voxels(t.spark.read.parquet(path), "int", skip=0)


#: Three boxes written one after another: they overlap, end inside chunks, and lie on other grids of chunks than the array.
UPDATES = ((0, 0, 0, 5, 70, 60, 1), (3, 50, 40, 4, 40, 60, 2), (2, 60, 30, 2, 8, 9, 3))


@query("snk_01_block_update", "vox grid", """
    SELECT z, y, x, raw * CASE WHEN z >= 2 AND z < 4 AND y >= 60 AND y < 68 AND x >= 30 AND x < 39 THEN 3 WHEN z >= 3 AND y >= 50 AND y < 90 AND x >= 40 THEN 2 ELSE 1 END AS v FROM vox
    WHERE z < 5 AND y < 70 AND x < 60 OR z >= 3 AND y >= 50 AND y < 90 AND x >= 40 OR z >= 2 AND z < 4 AND y >= 60 AND y < 68 AND x >= 30 AND x < 39""")
def _(t):
    path, whole = scratch_path(t.spark, "arrays"), _box(t)
    layout = arrays.Layout(*whole, (3, 32, 48), "int32")
    for k, (oz, oy, ox, sz, sy, sx, times) in enumerate(UPDATES):
        blocks = B.voxels_to_blocks(t.vox.withColumn("raw", F.col("raw") * times), *whole, CHUNK if k else (2, 40, 100), "int32", value="raw")
        arrays.update_blocks(blocks, path, "cell", "raw", ((oz, oy, ox), (sz, sy, sx)), layout)
    return B.blocks_to_voxels(arrays.read_array(t.spark, path, "cell", "raw"), "int", skip=0)


@query("src_03_read_configs", "boxes", """
    SELECT 'CELL_' || id AS nickname, 'data/cell_' || id || '.zarr' AS file, oy AS offset_y, 3 * sy AS shape_y, 'volumes/labels/' || organelle AS label, organelle + 1 AS class_id FROM boxes""")
def _(t):
    path = scratch_path(t.spark, "configs")
    ints = lambda *cols: F.array(*[F.col(c).cast("int") for c in cols])
    entry = F.struct(
        F.concat(F.lit("cell_"), F.col("id"), F.lit(".zarr")).alias("file"), ints("oz", "oy", "ox").alias("offset"), F.transform(ints("sz", "sy", "sx"), lambda v: v * 3).alias("shape"),
        F.lit("volumes/raw").alias("raw"), F.create_map(F.concat(F.lit("volumes/labels/"), F.col("organelle")), (F.col("organelle") + 1).cast("int")).alias("labels"),
    )
    t.boxes.select(F.to_json(F.create_map(F.concat(F.lit("cell_"), F.col("id")), entry)).alias("value")).write.text(path)
    parsed = configs.parse_configs(t.spark.read.text(path), "data")
    return parsed.select("nickname", "file", F.col("offset")[1].alias("offset_y"), F.col("shape")[1].alias("shape_y"), F.explode("labels").alias("label", "class_id"))


@query("src_05_configs_from_catalog", "boxes", """
    SELECT 'CROP' || id || '_' || n AS nickname, oy * 2 AS offset_y, sx AS shape_x, organelle + 1 AS class_id, CASE WHEN n = 'mito' THEN 'volumes/metric_masks/mito' END AS metric_mask
    FROM (SELECT *, CASE organelle WHEN 0 THEN 'mito' ELSE 'np' || organelle END AS n FROM boxes)""".replace("|| n AS nickname", "|| upper(n) AS nickname"))
def _(t):
    name = F.when(F.col("organelle") == 0, "mito").otherwise(F.concat(F.lit("np"), F.col("organelle")))
    spec = t.boxes.select(
        F.concat(F.lit("crop"), F.col("id")).alias("crop"), name.alias("organelle"), F.lit("a.zarr").alias("file"), F.concat(F.lit("volumes/labels/"), name).alias("array"),
        F.array("sz", "sy", "sx").cast("array<bigint>").alias("shape_vox"), F.array(*[F.col(c) * 8.0 for c in ("oz", "oy", "ox")]).alias("offset_nm"), F.array(*[F.lit(4.0)] * 3).alias("voxel_size_nm"),
    )
    made = configs.configs_from_catalog(spec, {"mito": 1, **{f"np{k}": k + 1 for k in range(1, 5)}})
    rows = configs.parse_configs(made.select(F.col("json").alias("value")))
    return rows.select("nickname", F.col("offset")[1].alias("offset_y"), F.col("shape")[2].alias("shape_x"), F.map_values("labels")[0].alias("class_id"), F.get("metric_masks", F.lit(0)).alias("metric_mask"))


@query("src_07_verify_sections", "vox", f"SELECT 'section_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END || '.tif' AS name FROM (SELECT unnest(range({HEIGHT})) AS n) WHERE n % 7 = 3")
def _(t):
    """The volume cut along y into image files, of which every seventh is then spoilt; those that can't be read are named."""
    depth, height, width = _box(t)[1]
    turned = t.vox.select(F.col("y").alias("z"), F.col("z").alias("y"), "x", "raw")
    folder = uri(t.spark, scratch_path(t.spark, "sections"))
    n = sections.export_sections(B.voxels_to_blocks(turned, (0, 0, 0), (height, depth, width), (64, 4, 64), "uint8", value="raw"), folder)
    sections.spoil(t.spark.range(n).filter("id % 7 = 3").select(F.format_string("section_%04d.tif", "id").alias("name")), folder)
    return sections.verify_sections(sections.scan_sections(t.spark, folder)).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"))


@query("snk_04_section_files", "vox", "SELECT z, y, x, raw AS v FROM vox WHERE raw != 0")
def _(t):
    folder = uri(t.spark, scratch_path(t.spark, "sections"))
    sections.export_sections(_raw_blocks(t), folder)
    return B.blocks_to_voxels(sections.sections_to_blocks(sections.scan_sections(t.spark, folder), *_box(t), CHUNK), "int", skip=0)


PLANES = "SELECT z, y, x, CAST(255 - raw AS INT) AS v FROM vox"


@query("src_08_sections_to_blocks", "vox", PLANES)
def _(t):
    planes = sections.blocks_to_sections(_raw_blocks(t)).withColumnRenamed("z", "number")
    offset, shape = _box(t)
    blocks = sections.sections_to_blocks(planes, offset, shape, CHUNK, invert=True)
    return B.blocks_to_voxels(blocks, "int", skip=255)


@query("snk_04_section_export", "vox", """SELECT 'section_' || lpad(CAST(z AS VARCHAR), 4, '0') AS name, z, max(h) AS height, 100 AS width, CAST(max(h) * 100 AS BIGINT) AS n_bytes
    FROM vox, (SELECT max(y) + 1 AS h FROM vox) GROUP BY z""")
def _(t):
    return sections.blocks_to_sections(_raw_blocks(t)).select("name", "z", "height", "width", F.length("data").cast("long").alias("n_bytes"))


@query("src_09_import_volumes", "vox", f"""
    SELECT 'volumes/raw' AS "array", z, y, x, raw AS v FROM vox
    UNION ALL SELECT 'volumes/gt/crop1', z // 2, ({HEIGHT} - 1) // 2 - y // 2, x // 2, gt FROM vox WHERE gt IS NOT NULL AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0""")
def _(t):
    raw = t.vox.select("z", "y", "x", (F.col("raw") * 256).alias("v"))
    gt = t.vox.filter("gt IS NOT NULL").select("z", "y", "x", F.col("gt").alias("v"))
    sources = {"x/raw": raw, "x/groundtruth/0001/crop1/labels/all": gt}
    pairs = [("x/raw", "volumes/raw"), *chunks.crop_targets(list(sources), "groundtruth/0001", "labels/all", "volumes/gt")]
    return chunks.import_volumes(sources, pairs, ny=_box(t)[1][1])


@query("src_09_import_attributes", "boxes", """
    SELECT CASE WHEN id % 4 = 0 THEN 'volumes/raw_' || id ELSE 'volumes/gt/crop' || id END AS "array",
           CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(trunc(ox * 2) AS BIGINT) * 5 END AS oz_nm,
           CASE WHEN id % 4 = 0 THEN 0 ELSE (1000 - CAST(trunc(oy * 2) AS BIGINT) - CAST(trunc(sy * 0.5) AS BIGINT) - CASE WHEN id % 4 = 1 THEN 10 ELSE 0 END) * 4 END AS oy_nm,
           CASE WHEN id % 4 = 0 THEN 0 ELSE CAST(trunc(oz * 2) AS BIGINT) * 4 END AS ox_nm FROM boxes""")
def _(t):
    line = F.when(F.col("id") % 4 == 1, "jurkat").otherwise("hela")
    source = F.when(F.col("id") % 4 == 0, F.concat(F.lit("x/raw_"), F.col("id"))).otherwise(F.concat(line, F.lit("/groundtruth/0001/crop"), F.col("id"), F.lit("/labels/all")))
    spec = t.boxes.select(source.alias("array"), (F.col("ox") * 8).alias("iz"), (F.col("oy") * 8).alias("iy"), (F.col("oz") * 8).alias("ix"), F.col("sy").alias("dy"))
    names = [r.array for r in spec.select("array").collect()]  # one a dataset
    pairs = [*chunks.crop_targets(names, "groundtruth/0001", "labels/all", "volumes/gt"), *[(n, n.replace("x/", "volumes/", 1)) for n in names if n.startswith("x/raw")]]
    return chunks.import_attributes(spec, pairs, 1000, (5, 4, 4)).drop("resolution")
