"""Queries of neighbourhoods, histograms, scores, losses, sampling, prediction and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import scratch_path
from ..operators import blocks as B
from ..operators import block_components, block_contrast, block_sums, deform, histogram, loss, merge, metrics, neighbourhood, predict, resample, roi, runlog, sample
from . import jobs
from .registry import draw_sql, query

KEY = ["z", "y", "x"]
BALL2 = "(SELECT * FROM (SELECT unnest(range(-2, 3)) AS dz), (SELECT unnest(range(-2, 3)) AS dy), (SELECT unnest(range(-2, 3)) AS dx) WHERE abs(dz) + abs(dy) + abs(dx) <= 2)"
ROUND2 = BALL2.replace("abs(dz) + abs(dy) + abs(dx) <= 2", "dz * dz + dy * dy + dx * dx <= 4")
ROUND1 = BALL2.replace("<= 2", "<= 1")
HEIGHT = "(SELECT max(y) + 1 FROM vox)"
IN_BOX = f"z >= 0 AND z < 7 AND y >= 0 AND y < {HEIGHT} AND x >= 0 AND x < 100"
FG = "fg AS (SELECT z, y, x FROM blob WHERE id <> 0)"


def _sel(body: str) -> str:
    """A statement with its own common table expressions below those of the views."""
    return f"SELECT * FROM ({body})"


#: Of the blocks that queries make from voxels.
CHUNK = (4, 64, 64)


def _box(t):
    return (0, 0, 0), (7, t.vox.agg(F.max("y")).first()[0] + 1, 100)


def _fg(t):
    return t.blob.filter("id != 0").select(*KEY)


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


WIDE = f"wide AS (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM fg, {BALL2})"
NARROW = f"narrow AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x FROM fg, {BALL2} GROUP BY 1, 2, 3 HAVING count(*) = 25)"


DILATED = _sel(f"WITH {FG}, {WIDE} SELECT * FROM wide WHERE {IN_BOX}")


@query("nbh_01_dilate", "blob", DILATED)
def _(t):
    return neighbourhood.dilate(_fg(t), 2, _box(t))


ERODED = _sel(f"WITH {FG}, {NARROW} SELECT * FROM narrow")


@query("nbh_02_erode", "blob", ERODED)
def _(t):
    return neighbourhood.erode(_fg(t), 2)


BALLED = _sel(f"WITH {FG} SELECT * FROM (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM fg, {ROUND2}) WHERE {IN_BOX}")


@query("nbh_03_dilate_ball", "blob", BALLED)
def _(t):
    return neighbourhood.dilate_ball(_fg(t), 2, _box(t))


BOUNDARY = _sel(f"WITH {FG} SELECT * FROM (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM fg, {ROUND2}) WHERE {IN_BOX} EXCEPT SELECT * FROM fg")


@query("nbh_04_boundary", "blob", BOUNDARY)
def _(t):
    return neighbourhood.boundary(_fg(t), 2, _box(t))


EXCLUDED = f"""WITH {FG}, near AS (SELECT z + dz AS z, y + dy AS y, x + dx AS x, count(*) AS n FROM fg, {BALL2} GROUP BY 1, 2, 3)
    SELECT g.z, g.y, g.x, CASE WHEN b.n < 25 THEN 0 ELSE 255 END AS mask FROM grid g LEFT JOIN near b ON g.z = b.z AND g.y = b.y AND g.x = b.x"""


@query("nbh_05_metric_mask", "blob grid", _sel(EXCLUDED))
def _(t):
    return neighbourhood.metric_mask(t.grid, _fg(t), 2, 2)


@query("nbh_05_metric_mask_blocks", "blob grid", _sel(EXCLUDED))
def _(t):
    box, chunk = _box(t), CHUNK
    blocks = B.voxels_to_blocks(t.blob, *box, chunk, "int32", value="id")
    n, kernel = B.metric_mask_kernel(2, 2)
    return B.blocks_to_voxels(B.with_halo(blocks, (n,) * 3, kernel, box, chunk, dtype="uint8"), "int").withColumnRenamed("v", "mask")


INSTANCES = f"SELECT * FROM (SELECT z + dz AS z, y + dy AS y, x + dx AS x, max(id) AS id FROM (SELECT * FROM blob WHERE id <> 0), {BALL2} GROUP BY 1, 2, 3) WHERE {IN_BOX}"


@query("nbh_06_dilate_instances", "blob", INSTANCES)
def _(t):
    return neighbourhood.dilate_instances(t.blob, 2, _box(t))


def _ero(src: str, name: str, ball: str = ROUND2) -> str:
    """The oracle's erosion by the round ball, outside the box as foreground."""
    return f"""{name} AS (SELECT p.z, p.y, p.x FROM (SELECT z, y, x FROM grid) p, {ball} o
        LEFT JOIN {src} s ON s.z = p.z + o.dz AND s.y = p.y + o.dy AND s.x = p.x + o.dx
        WHERE p.z + o.dz BETWEEN 0 AND 6 AND p.y + o.dy BETWEEN 0 AND {HEIGHT} - 1 AND p.x + o.dx BETWEEN 0 AND 99
        GROUP BY p.z, p.y, p.x HAVING count(*) = count(s.z))"""


def _dil(src: str, name: str, ball: str = ROUND2) -> str:
    return f"{name} AS (SELECT * FROM (SELECT DISTINCT z + dz AS z, y + dy AS y, x + dx AS x FROM {src}, {ball}) WHERE {IN_BOX})"


def _large(src: str, name: str, min_size: int) -> str:
    """The oracle's components of at least ``min_size`` voxels, for a recursive statement: labels pass between touching runs along x until none sinks."""
    return f"""{name}_runs AS (SELECT z, y, min(x) AS a, max(x) AS b, (z * {HEIGHT} + y) * 100 + min(x) AS r
            FROM (SELECT z, y, x, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS k FROM {src}) GROUP BY z, y, k),
        {name}_met AS (SELECT p.r AS u, s.r AS v FROM {name}_runs p JOIN {name}_runs s ON s.z = p.z AND s.y = p.y + 1 AND s.a <= p.b AND s.b >= p.a
            UNION ALL SELECT p.r, s.r FROM {name}_runs p JOIN {name}_runs s ON s.z = p.z + 1 AND s.y = p.y AND s.a <= p.b AND s.b >= p.a),
        {name}_links AS (SELECT u, v FROM {name}_met UNION ALL SELECT v, u FROM {name}_met),
        {name}_labels(r, c) USING KEY (r) AS (SELECT r, r FROM {name}_runs UNION
            SELECT e.u, min(l.c) FROM {name}_labels l JOIN {name}_links e ON e.v = l.r JOIN recurring.{name}_labels o ON o.r = e.u WHERE l.c < o.c GROUP BY e.u),
        {name} AS (SELECT z, y, unnest(range(a, b + 1)) AS x FROM {name}_runs JOIN {name}_labels USING (r)
            WHERE c IN (SELECT c FROM {name}_runs JOIN {name}_labels USING (r) GROUP BY c HAVING sum(b - a + 1) >= {min_size}))"""


OPENED = _sel(f"WITH {FG}, {_ero('fg', 'e')}, {_dil('e', 'd')} SELECT * FROM d")


@query("nbh_07_open_ball", "blob grid", OPENED)
def _(t):
    return neighbourhood.open_ball(_fg(t), 2, _box(t))


CLOSED = _sel(f"WITH {FG}, {_dil('fg', 'd')}, {_ero('d', 'e')} SELECT * FROM e")


@query("nbh_07_close_ball", "blob grid", CLOSED)
def _(t):
    return neighbourhood.close_ball(_fg(t), 2, _box(t))


LARGE = _sel(f"WITH RECURSIVE {FG}, {_large('fg', 'kept', 200)} SELECT * FROM kept")


@query("nbh_08_remove_small", "blob", LARGE)
def _(t):
    return neighbourhood.remove_small(_fg(t), 200)


FOREGROUND = _sel(f"""WITH RECURSIVE s AS (SELECT z, y, x FROM vox WHERE raw > 2 AND raw < 250),
        {_ero("s", "e1", ROUND1)}, {_dil("e1", "d1", ROUND1)}, {_dil("d1", "d2", ROUND1)}, {_ero("d2", "e2", ROUND1)},
        empty AS (SELECT z, y, x FROM grid EXCEPT SELECT z, y, x FROM e2), {_large("empty", "holes", 50)},
        filled AS (SELECT z, y, x FROM grid EXCEPT SELECT z, y, x FROM holes), {_large("filled", "kept", 50)}
    SELECT g.z, g.y, g.x, CASE WHEN k.z IS NULL THEN 0 ELSE 255 END AS mask FROM grid g LEFT JOIN kept k ON g.z = k.z AND g.y = k.y AND g.x = k.x""")


@query("nbh_09_foreground_mask", "vox grid", FOREGROUND)
def _(t):
    raw = t.grid.join(t.vox.select(*KEY, "raw"), KEY, "left").select(*KEY, F.coalesce("raw", F.lit(0)).alias("v"))
    return neighbourhood.foreground_mask(raw, _box(t), 2, 250, 1, 1, 50)


def _swept_voxels(t, context: int, kernel, fill=0, dtype="uint8"):
    """The blocks of the view blob through a kernel, foreground voxels of the result."""
    box = _box(t)
    blocks = B.voxels_to_blocks(t.blob, *box, CHUNK, "int32", value="id")
    return B.blocks_to_voxels(B.with_halo(blocks, (context,) * 3, kernel, box, CHUNK, fill, dtype), "int", skip=0)


@query("nbh_01_dilate_blocks", "blob", DILATED)
def _(t):
    return _swept_voxels(t, 2, B.dilate_kernel(neighbourhood.cross_ball(2), (2,) * 3)).select(*KEY)


@query("nbh_02_erode_blocks", "blob", ERODED)
def _(t):
    return _swept_voxels(t, 2, B.erode_kernel(neighbourhood.cross_ball(2), (2,) * 3)).select(*KEY)


@query("nbh_03_dilate_ball_blocks", "blob", BALLED)
def _(t):
    return _swept_voxels(t, 2, B.dilate_kernel(neighbourhood.round_ball(2), (2,) * 3)).select(*KEY)


@query("nbh_04_boundary_blocks", "blob", BOUNDARY)
def _(t):
    return _swept_voxels(t, 2, B.boundary_kernel(neighbourhood.round_ball(2), (2,) * 3)).select(*KEY)


@query("nbh_06_dilate_instances_blocks", "blob", INSTANCES)
def _(t):
    return _swept_voxels(t, 2, B.instances_kernel(neighbourhood.cross_ball(2), (2,) * 3), dtype="int32").withColumnRenamed("v", "id")


@query("nbh_07_open_ball_blocks", "blob grid", OPENED)
def _(t):
    return _swept_voxels(t, *B.sweep_kernel([("open", 2)]), B.OUTSIDE).select(*KEY)


@query("nbh_07_close_ball_blocks", "blob grid", CLOSED)
def _(t):
    return _swept_voxels(t, *B.sweep_kernel([("close", 2)]), B.OUTSIDE).select(*KEY)


@query("nbh_09_foreground_mask_blocks", "vox grid", FOREGROUND)
def _(t):
    box = _box(t)
    raw = t.grid.join(t.vox.select(*KEY, "raw"), KEY, "left").select(*KEY, F.coalesce("raw", F.lit(0)).alias("v"))
    mask = neighbourhood.foreground_mask_blocks(B.voxels_to_blocks(raw, *box, CHUNK, "int16"), box, CHUNK, 2, 250, 1, 1, 50)
    return B.blocks_to_voxels(mask, "int").withColumnRenamed("v", "mask")


@query("nbh_08_remove_small_blocks", "blob", LARGE)
def _(t):
    box = _box(t)
    return B.blocks_to_voxels(block_components.remove_small_blocks(B.voxels_to_blocks(t.blob, *box, CHUNK, "int32", value="id"), 200, box, CHUNK), "int", skip=0).select(*KEY)


TAPS = {(0, 0, 0): 4.0, (0, 0, 1): 2.0, (0, 1, 0): -1.0, (-1, 0, 0): 3.0}
TAPS2 = {(1, 1, 1): 1.0, (0, 0, -1): -2.0}
CONV = """(SELECT v.z, v.y, v.x, 4 * v.raw + 2 * coalesce(a.raw, 0) - coalesce(b.raw, 0) + 3 * coalesce(c.raw, 0) + 0.5 AS s0,
        coalesce(d.raw, 0) - 2 * coalesce(e.raw, 0) - 1.0 AS s1 FROM vox v
    LEFT JOIN vox a ON a.z = v.z AND a.y = v.y AND a.x = v.x + 1 LEFT JOIN vox b ON b.z = v.z AND b.y = v.y + 1 AND b.x = v.x
    LEFT JOIN vox c ON c.z = v.z - 1 AND c.y = v.y AND c.x = v.x LEFT JOIN vox d ON d.z = v.z + 1 AND d.y = v.y + 1 AND d.x = v.x + 1
    LEFT JOIN vox e ON e.z = v.z AND e.y = v.y AND e.x = v.x - 1)"""


def _raw(t):
    return t.vox.select(*KEY, F.col("raw").alias("v"))


@query("nbh_10_convolve", "vox", f"SELECT z, y, x, 0 AS c, CAST(s0 AS DOUBLE) AS v FROM {CONV} UNION ALL SELECT z, y, x, 1, CAST(s1 AS DOUBLE) FROM {CONV}")
def _(t):
    return neighbourhood.convolve(_raw(t), [TAPS, TAPS2], [0.5, -1.0])


@query("roi_10_halo_stencil_blocks", "vox grid", f"""
    SELECT g.z, g.y, g.x, CAST(4 * coalesce(v.raw, 0) + 2 * coalesce(a.raw, 0) - coalesce(b.raw, 0) + 3 * coalesce(c.raw, 0) + 0.5 AS DOUBLE) AS v FROM grid g
    LEFT JOIN vox v ON v.z = g.z AND v.y = g.y AND v.x = g.x LEFT JOIN vox a ON a.z = g.z AND a.y = g.y AND a.x = g.x + 1
    LEFT JOIN vox b ON b.z = g.z AND b.y = g.y + 1 AND b.x = g.x LEFT JOIN vox c ON c.z = g.z - 1 AND c.y = g.y AND c.x = g.x""")
def _(t):
    box, chunk = _box(t), CHUNK
    blocks = B.voxels_to_blocks(t.vox, *box, chunk, "int32", value="raw")
    return B.blocks_to_voxels(B.with_halo(blocks, (1, 1, 1), B.convolve_kernel(TAPS, 0.5), box, chunk, dtype="float64"))


GREY = "CAST(round_even((raw - 5) / CAST(245 AS DOUBLE) * 16383, 0) AS INT)"
TILE = "CAST(floor((z + 4) / 8.0) AS BIGINT) AS tz, CAST(floor((y + 4) / 8.0) AS BIGINT) AS ty, CAST(floor((x + 4) / 8.0) AS BIGINT) AS tx"


def _grey(t):
    return t.vox.select(*KEY, histogram.to_14bit(F.col("raw"), 5, 250).alias("g"))


@query("his_01_tile_histogram", "vox", f"SELECT {TILE}, {GREY} // 65 AS bin, count(*) AS n FROM vox GROUP BY 1, 2, 3, 4")
def _(t):
    return histogram.tile_histogram(_grey(t), 8)


def _clip(counts: str, name: str, limit: int) -> str:
    """The oracle's clipped counts (tz, ty, tx, room) of full histograms, for a recursive statement: ``room`` lists what each bin still takes."""
    return f"""{name}_full AS (SELECT tz, ty, tx, list(greatest({limit} - n, 0) ORDER BY bin) AS room, CAST(sum(greatest(n - {limit}, 0)) AS BIGINT) AS spare FROM {counts} GROUP BY ALL),
        {name}_even AS (SELECT tz, ty, tx, list_transform(room, lambda v: v - least(v, spare // 256)) AS room,
            CAST(spare - list_sum(list_transform(room, lambda v: least(v, spare // 256))) AS BIGINT) AS spare FROM {name}_full),
        {name}_walk AS (SELECT *, 0 AS step FROM {name}_even UNION ALL
            SELECT tz, ty, tx, list_transform(room, lambda v, i: v - spots[i]), CAST(spare - list_sum(spots) AS BIGINT), step + 1
            FROM (SELECT *, list_transform(room, lambda v, i: CAST(v > 0 AND i > step % 256 AND (i - 1 - step % 256) % stride = 0 AS BIGINT)) AS spots
                FROM (SELECT *, greatest(1, len(list_filter(room, lambda v: v > 0)) // spare) AS stride FROM {name}_walk WHERE spare > 0 AND list_max(room) > 0))),
        {name} AS (SELECT tz, ty, tx, room FROM {name}_walk WHERE spare <= 0 OR list_max(room) = 0)"""


@query("his_02_clip_histogram", "vox", _sel(f"""
    WITH RECURSIVE tiled AS (SELECT {TILE}, {GREY} // 65 AS bin, count(*) AS n FROM vox GROUP BY 1, 2, 3, 4),
        counts AS (SELECT tz, ty, tx, bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT tz, ty, tx FROM tiled) CROSS JOIN (SELECT unnest(range(256)) AS bin) LEFT JOIN tiled USING (tz, ty, tx, bin)),
        {_clip("counts", "clipped", 10)}
    SELECT tz, ty, tx, CAST(unnest(range(256)) AS INT) AS bin, 10 - unnest(room) AS n FROM clipped"""))
def _(t):
    return histogram.clip_histogram(histogram.tile_histogram(_grey(t), 8), 10)


@query("his_03_map_histogram", "vox", f"""
    SELECT tz, ty, tx, bin, CAST(least(floor(sum(n) OVER (PARTITION BY tz, ty, tx ORDER BY bin) * (16383 / CAST(512 AS DOUBLE))), 16383) AS INT) AS m
    FROM (SELECT {TILE}, {GREY} // 65 AS bin, count(*) AS n FROM vox GROUP BY 1, 2, 3, 4)""")
def _(t):
    return histogram.map_histogram(histogram.tile_histogram(_grey(t), 8), 512)


@query("his_04_apply_mapping", "vox", f"""
    SELECT z, y, x, round(sum(w * coalesce(m, 0)), 6) AS v FROM (
      SELECT z, y, x, g // 65 AS bin, z // 8 + a AS tz, y // 8 + b AS ty, x // 8 + c AS tx,
             (CASE a WHEN 1 THEN z % 8 / CAST(8 AS DOUBLE) ELSE 1 - z % 8 / CAST(8 AS DOUBLE) END) * (CASE b WHEN 1 THEN y % 8 / CAST(8 AS DOUBLE) ELSE 1 - y % 8 / CAST(8 AS DOUBLE) END)
             * (CASE c WHEN 1 THEN x % 8 / CAST(8 AS DOUBLE) ELSE 1 - x % 8 / CAST(8 AS DOUBLE) END) AS w
      FROM (SELECT z, y, x, {GREY} AS g FROM vox), (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), (VALUES (0), (1)) r(c))
    LEFT JOIN (SELECT tz, ty, tx, bin, CAST(least(floor(sum(n) OVER (PARTITION BY tz, ty, tx ORDER BY bin) * (16383 / CAST(512 AS DOUBLE))), 16383) AS INT) AS m
               FROM (SELECT {TILE}, {GREY} // 65 AS bin, count(*) AS n FROM vox GROUP BY 1, 2, 3, 4)) USING (tz, ty, tx, bin)
    GROUP BY z, y, x""")
def _(t):
    maps = histogram.map_histogram(histogram.tile_histogram(_grey(t), 8), 512)
    return _r(histogram.apply_mapping(_grey(t), maps, 8), "v")


GREY5 = "CAST(round_even({} / CAST(255 AS DOUBLE) * 16383, 0) AS INT) // 65"


def _tiles_met(name: str, length: str) -> str:
    """The oracle's tiles of side 8 that a place of an axis counts in: its own and, near the end, that of its mirror image."""
    return f"""{name}(p, t) AS (SELECT p, (p + 4) // 8 FROM (SELECT unnest(range({length})) AS p) UNION ALL
            SELECT p, (2 * {length} + 10 - p) // 8 FROM (SELECT unnest(range({length})) AS p) WHERE 2 * {length} + 6 - p <= ({length} + 15) // 8 * 8 - 5)"""


CLAHE = _sel(f"""
    WITH RECURSIVE {_tiles_met("mz", "7")}, {_tiles_met("my", HEIGHT)}, {_tiles_met("mx", "100")},
        fill AS (SELECT {GREY5.format("floor(sum(raw) / count(*))")} AS fill FROM vox),
        tiled AS (SELECT mz.t AS tz, my.t AS ty, mx.t AS tx, {GREY5.format("raw")} AS bin, count(*) AS n FROM vox JOIN mz ON z = mz.p JOIN my ON y = my.p JOIN mx ON x = mx.p GROUP BY 1, 2, 3, 4),
        total AS (SELECT tz, ty, tx, sum(n) AS n FROM tiled GROUP BY 1, 2, 3),
        tile AS (SELECT * FROM (SELECT unnest(range(2)) AS tz), (SELECT unnest(range(({HEIGHT} + 15) // 8)) AS ty), (SELECT unnest(range(14)) AS tx)),
        counts AS (SELECT tz, ty, tx, bin, CAST(coalesce(tiled.n, 0) + CASE WHEN bin = fill THEN 512 - coalesce(total.n, 0) ELSE 0 END AS BIGINT) AS n
            FROM tile CROSS JOIN (SELECT unnest(range(256)) AS bin) CROSS JOIN fill LEFT JOIN tiled USING (tz, ty, tx, bin) LEFT JOIN total USING (tz, ty, tx)),
        {_clip("counts", "clipped", 10)},
        bins AS (SELECT tz, ty, tx, unnest(range(256)) AS bin, 10 - unnest(room) AS n FROM clipped),
        maps AS (SELECT tz, ty, tx, bin, least(floor(sum(n) OVER (PARTITION BY tz, ty, tx ORDER BY bin) * (16383 / CAST(512 AS DOUBLE))), 16383) AS m FROM bins),
        corners AS (SELECT z, y, x, {GREY5.format("raw")} AS bin, least(z // 8 + a, 1) AS tz, least(y // 8 + b, ({HEIGHT} + 15) // 8 - 1) AS ty, least(x // 8 + c, 13) AS tx,
                (CASE a WHEN 1 THEN z % 8 ELSE 8 - z % 8 END) * (CASE b WHEN 1 THEN y % 8 ELSE 8 - y % 8 END) * (CASE c WHEN 1 THEN x % 8 ELSE 8 - x % 8 END) / CAST(512 AS DOUBLE) AS w
            FROM vox, (VALUES (0), (1)) p(a), (VALUES (0), (1)) q(b), (VALUES (0), (1)) r(c))
    SELECT z, y, x, CAST(floor(floor(sum(w * m)) / CAST(16383 AS DOUBLE) * 255) AS INT) AS v FROM corners JOIN maps USING (tz, ty, tx, bin) GROUP BY z, y, x""")


@query("his_05_clahe", "vox", CLAHE)
def _(t):
    return histogram.clahe(_raw(t), 8, 0.02)


@query("his_05_clahe_blocks", "vox", CLAHE)
def _(t):
    box = _box(t)
    blocks = B.voxels_to_blocks(t.vox, *box, CHUNK, "int16", block_contrast.ABSENT, value="raw")
    return B.blocks_to_voxels(block_contrast.clahe_blocks(blocks, box, CHUNK, 8, 0.02), "int", skip=block_contrast.ABSENT)


@query("his_06_match_histograms", "vox", """
    WITH s AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS q FROM (SELECT raw AS v, count(*) AS n FROM vox WHERE mask <> 0 GROUP BY 1)),
    t AS (SELECT v, sum(n) OVER (ORDER BY v) / sum(n) OVER () AS q FROM (SELECT gt * 3 AS v, count(*) AS n FROM vox WHERE mmask <> 0 AND gt IS NOT NULL GROUP BY 1)),
    b AS (SELECT s.v, s.q, (SELECT max_by(t.v, t.q) FROM t WHERE t.q <= s.q) AS v0, (SELECT max(t.q) FROM t WHERE t.q <= s.q) AS q0,
                 (SELECT min_by(t.v, t.q) FROM t WHERE t.q >= s.q) AS v1, (SELECT min(t.q) FROM t WHERE t.q >= s.q) AS q1 FROM s),
    l AS (SELECT v, CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q1 = q0 THEN v0 ELSE v0 + (v1 - v0) * (q - q0) / (q1 - q0) END AS mapped FROM b)
    SELECT z, y, x, round(mapped, 6) AS mapped FROM vox LEFT JOIN l ON vox.raw = l.v""".replace("WITH s AS", "SELECT * FROM (WITH s AS", 1) + ")")
def _(t):
    src = t.vox.select(*KEY, F.col("raw").alias("v"), "mask")
    tmpl = t.vox.filter("gt IS NOT NULL").select((F.col("gt") * 3).alias("v"), F.col("mmask").alias("mask"))
    return _r(histogram.match_histograms(src, tmpl), "mapped").select(*KEY, "mapped")


@query("his_06_match_floats", "vox", _sel("""
    WITH x AS (SELECT z, y, x, raw + y / CAST(7 AS DOUBLE) + x / CAST(11 AS DOUBLE) AS v, prob * 3 - x / CAST(13 AS DOUBLE) AS w, mask, mmask FROM vox),
    s AS (SELECT v, sum(n) OVER (ORDER BY v) / (sum(n) OVER ()) AS q FROM (SELECT v, count(*) AS n FROM x WHERE mask <> 0 GROUP BY 1)),
    t AS (SELECT w, sum(n) OVER (ORDER BY w) / (sum(n) OVER ()) AS q FROM (SELECT w, count(*) AS n FROM x WHERE mmask <> 0 GROUP BY 1)),
    lo AS (SELECT s.v, s.q, t.w AS v0, t.q AS q0 FROM s ASOF LEFT JOIN t ON s.q >= t.q),
    b AS (SELECT lo.*, t.w AS v1, t.q AS q1 FROM lo ASOF LEFT JOIN t ON lo.q <= t.q)
    SELECT z, y, x, round(CASE WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL OR q1 = q0 THEN v0 ELSE v0 + (v1 - v0) * (q - q0) / (q1 - q0) END, 6) AS mapped FROM x JOIN b USING (v) WHERE mask <> 0"""))
def _(t):
    rows = t.vox.select(*KEY, (F.col("raw") + F.col("y") / 7 + F.col("x") / 11).alias("v"), (F.col("prob") * 3 - F.col("x") / 13).alias("w"), "mask", "mmask")
    src = rows.filter("mask != 0").select(*KEY, "v", "mask")
    return _r(histogram.match_histograms(src, rows.select(F.col("w").alias("v"), F.col("mmask").alias("mask"))), "mapped").select(*KEY, "mapped")


@query("his_07_value_range", "vox", "SELECT min(raw) AS lo, max(raw) AS hi FROM vox")
def _(t):
    return histogram.value_range(t.vox, "raw")


# scores --------------------------------------------------------------------------------------------------------------

CELL = "SELECT * FROM vox WHERE mask <> 0 AND mmask <> 0"
TWO = f"SELECT lab_a AS t, CASE WHEN prob > 1 - prob THEN 1 ELSE 0 END AS p FROM ({CELL})"


def _cells(t):
    return metrics.masked(t.vox, "mask", "mmask")


def _two_class(t):
    return metrics.with_argmax(_cells(t), "prob")


def _count_sql(src: str, keys: str = "", classes: str = "(VALUES (0), (1))") -> str:
    group = f"{keys}, k" if keys else "k"
    return f"""(SELECT {group}, sum(CASE WHEN t = k AND p = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t <> k AND p = k THEN 1 ELSE 0 END) AS fp,
        sum(CASE WHEN t = k AND p <> k THEN 1 ELSE 0 END) AS fn FROM ({src}) s, {classes} c(k) GROUP BY {group})"""


JAC = "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / CAST(tp + fp + fn AS DOUBLE) END"
DICE = "CASE WHEN 2 * tp + fp + fn = 0 THEN CAST('nan' AS DOUBLE) ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END"
PREC = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END"
REC = "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END"


@query("agg_01_jaccard", "vox", f"SELECT k AS cls, round({JAC}, 6) AS jaccard FROM {_count_sql(TWO)}")
def _(t):
    return _r(metrics.jaccard(_two_class(t), "lab_a", "pred", (0, 1)), "jaccard")


@query("agg_01_jaccard_classes", "chan vox", f"""SELECT k AS cls, round({JAC}, 6) AS jaccard FROM {_count_sql('''
    SELECT v.lab_a + v.lab_b AS t, s.c AS p FROM (SELECT z, y, x, c, row_number() OVER (PARTITION BY z, y, x ORDER BY v DESC, c) AS r FROM chan) s
    JOIN vox v ON s.z = v.z AND s.y = v.y AND s.x = v.x WHERE r = 1 AND mask <> 0''', classes="(VALUES (0), (1), (2))")}""")
def _(t):
    seg = merge.argmax_segment(t.chan)
    rows = metrics.masked(t.vox, "mask").select(*KEY, (F.col("lab_a") + F.col("lab_b")).alias("target")).join(seg, KEY)
    return _r(metrics.jaccard(rows, "target", "seg", (0, 1, 2)), "jaccard")


@query("agg_02_pair_metric", "vox", f"""SELECT 'dice' AS metric, round({DICE}, 6) AS value FROM (SELECT tp, fp, fn FROM {_count_sql(TWO.replace("prob > 1 - prob", "prob >= 0.6"))} WHERE k = 1)
    UNION ALL SELECT 'jaccard', round({JAC}, 6) FROM (SELECT tp, fp, fn FROM {_count_sql(TWO.replace("prob > 1 - prob", "prob >= 0.6"))} WHERE k = 1)""")
def _(t):
    out = [metrics.pair_metric(_cells(t), m, "lab_a", "prob", 0.6).select(F.lit(m).alias("metric"), F.round(m, 6).alias("value")) for m in ("dice", "jaccard")]
    return out[0].unionByName(out[1])


@query("agg_03_precision_recall", "vox", f"""SELECT 'argmax' AS by_, k AS cls, round({PREC}, 6) AS "precision", round({REC}, 6) AS recall FROM {_count_sql(TWO)}
    UNION ALL SELECT 'at', k, round({PREC}, 6), round({REC}, 6) FROM {_count_sql(TWO.replace("prob > 1 - prob", "prob >= 0.3"))}""")
def _(t):
    a = metrics.precision_recall(_two_class(t), "lab_a", "pred", (0, 1)).withColumn("by_", F.lit("argmax"))
    b = metrics.precision_recall_at(_cells(t), "lab_a", "prob", 0.3).withColumn("by_", F.lit("at"))
    return _r(a.unionByName(b), "precision", "recall")


CURVE = """SELECT inst, s AS threshold, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY inst) AS pos, sum(n) OVER (PARTITION BY inst) AS neg
    FROM (SELECT inst, prob AS s, sum(lab_a) AS p, sum(1 - lab_a) AS n FROM vox GROUP BY 1, 2) WINDOW w AS (PARTITION BY inst ORDER BY s DESC)"""
CURVE = f"""SELECT inst, threshold, tp, fp, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS "precision", CASE WHEN pos = 0 THEN 0.0 ELSE tp / CAST(pos AS DOUBLE) END AS recall
    FROM (SELECT inst, threshold, tp, fp, pos FROM ({CURVE}) WHERE threshold <> 0 UNION ALL SELECT DISTINCT inst, CAST(0 AS DOUBLE), pos, neg, pos FROM ({CURVE}))"""


@query("agg_04_pr_curve", "vox", f'SELECT inst, threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM ({CURVE})')
def _(t):
    return _r(metrics.pr_curve(t.vox, "lab_a", "prob", ["inst"]), "precision", "recall")


@query("agg_05_average_precision", "vox", f"""SELECT inst, round(sum(gain * "precision"), 6) AS average_precision FROM (
    SELECT inst, "precision", recall - coalesce(lag(recall) OVER (PARTITION BY inst ORDER BY threshold DESC), 0) AS gain FROM ({CURVE})) GROUP BY inst""")
def _(t):
    return _r(metrics.average_precision(metrics.pr_curve(t.vox, "lab_a", "prob", ["inst"]), ["inst"]), "average_precision")


@query("agg_06_confusion_matrix", "vox", f"""SELECT a AS target, b AS pred, round(count(p) / CAST((SELECT count(*) FROM ({TWO})) AS DOUBLE), 6) AS share
    FROM (VALUES (0), (1)) x(a) CROSS JOIN (VALUES (0), (1)) y(b) LEFT JOIN ({TWO}) ON t = a AND p = b GROUP BY a, b""")
def _(t):
    return _r(metrics.confusion_matrix(_two_class(t), "lab_a", "pred", (0, 1)), "share")


SWEEP_COLUMNS = f"""threshold, tp, fp, fn, tn, round({JAC}, 6) AS jaccard, round({DICE}, 6) AS dice, round({PREC}, 6) AS "precision", round({REC}, 6) AS recall"""


def _sweep_sql(src: str) -> str:
    return f"""(SELECT CAST(h AS DOUBLE) AS threshold, CAST(sum(CASE WHEN lab_a <> 0 AND prob >= h THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN lab_a = 0 AND prob >= h THEN 1 ELSE 0 END) AS BIGINT) AS fp,
        CAST(sum(CASE WHEN lab_a <> 0 AND prob < h THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN lab_a = 0 AND prob < h THEN 1 ELSE 0 END) AS BIGINT) AS tn
        FROM ({src}), (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) t(h) GROUP BY h)"""


AT = metrics.thresholds(0.1, 0.9, 0.1)


@query("agg_07_threshold_sweep", "vox", f"SELECT {SWEEP_COLUMNS} FROM {_sweep_sql(CELL)}")
@query("agg_07_threshold_sweep_whole", "vox", f"SELECT {SWEEP_COLUMNS} FROM {_sweep_sql(CELL)}")
def _(t):
    return _r(metrics.sweep(_cells(t), "lab_a", "prob", AT), "jaccard", "dice", "precision", "recall")


@query("agg_07_best_threshold", "vox", f"""
    SELECT 'dice' AS metric, round(max(d), 6) AS score, max_by(threshold, (d, threshold)) AS threshold FROM (SELECT *, {DICE} AS d FROM {_sweep_sql(CELL)})
    UNION ALL SELECT 'precision_recall', round(max(d), 6), max_by(threshold, (d, threshold)) FROM (SELECT *, {PREC} + {REC} AS d FROM {_sweep_sql(CELL)})""")
def _(t):
    swept = metrics.sweep(_cells(t), "lab_a", "prob", AT)
    out = [metrics.best_threshold(swept, m).select(F.lit(m).alias("metric"), F.round("score", 6).alias("score"), "threshold") for m in ("dice", "precision_recall")]
    return out[0].unionByName(out[1])


INNER = " AND ".join(f"{a} > (SELECT min({a}) FROM vox) AND {a} < (SELECT max({a}) FROM vox)" for a in KEY)


@query("agg_08_evaluate", "vox", f"SELECT {SWEEP_COLUMNS} FROM {_sweep_sql(CELL + ' AND ' + INNER)}")
@query("agg_08_evaluate_whole", "vox", f"SELECT {SWEEP_COLUMNS} FROM {_sweep_sql(CELL + ' AND ' + INNER)}")
def _(t):
    return _r(jobs.evaluate(t.vox, "lab_a", "prob", ["mask", "mmask"], roi.extent(t.vox), 1, AT), "jaccard", "dice", "precision", "recall")


REPORT = f"SELECT inst, lab_a AS t, CASE WHEN prob > 1 - prob THEN 1 ELSE 0 END AS p FROM ({CELL})"


@query("agg_09_score_report", "vox", f"""SELECT inst, k AS cls, round({JAC}, 6) AS jaccard, round({DICE}, 6) AS dice, round({PREC}, 6) AS "precision", round({REC}, 6) AS recall FROM {_count_sql(REPORT, "inst")}""")
def _(t):
    return _r(metrics.score_report(_two_class(t), ["inst"], "lab_a", "pred", (0, 1)), "jaccard", "dice", "precision", "recall")


@query("agg_10_class_balance", "vox", "SELECT y, lab_a, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE), 6) AS share FROM vox GROUP BY y, lab_a")
def _(t):
    return _r(metrics.class_balance(t.vox, ["y"], "lab_a"), "share")


BALANCED = """SELECT v.*, CASE WHEN mask <> 0 THEN 1 / (2 * least(greatest(coalesce(s, 0), 0.05), 0.95)) ELSE 0 END AS scale FROM vox v
    LEFT JOIN (SELECT y AS by_, lab_a AS la, count(*) / CAST(sum(count(*)) OVER (PARTITION BY y) AS DOUBLE) AS s FROM vox WHERE mask <> 0 GROUP BY y, lab_a) ON y = by_ AND lab_a = la"""


@query("agg_11_balance_scale", "vox", f"SELECT z, y, x, round(scale, 6) AS scale FROM ({BALANCED})")
def _(t):
    return _r(metrics.balance_scale(t.vox, ["y"], "lab_a", "mask", 2), "scale").select(*KEY, "scale")


SCORES = ["s0", "s1"]
NLL = "-(CASE WHEN lab_a = 1 THEN s1 ELSE s0 END - greatest(s0, s1) - ln(exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))))"
WGT = "(CASE WHEN lab_a = 1 THEN 0.8 ELSE 0.2 END)"
SCORED = f"SELECT *, 1.5 - prob AS s0, prob * 2 AS s1 FROM ({BALANCED})"


def _scored(t):
    rows = metrics.balance_scale(t.vox, ["y"], "lab_a", "mask", 2)
    return rows.withColumns({"s0": 1.5 - F.col("prob"), "s1": F.col("prob") * 2})


@query("agg_12_cross_entropy", "vox", f"SELECT round(sum({NLL} * {WGT} * mask * scale) / sum(scale), 6) AS loss FROM ({SCORED})")
def _(t):
    return _r(loss.cross_entropy(_scored(t), SCORES, "lab_a", "scale", "mask", [0.2, 0.8]), "loss")


@query("agg_13_cross_entropy_mean", "vox", f"SELECT round(sum({NLL} * {WGT}) / sum({WGT}), 6) AS loss FROM ({SCORED})")
def _(t):
    return _r(loss.cross_entropy_mean(_scored(t), SCORES, "lab_a", [0.2, 0.8]), "loss")


SQ = "(pow(prob - raw / CAST(255 AS DOUBLE), 2) + pow(prob / 2 - inst / CAST(255 AS DOUBLE), 2)) / 2"


@query("agg_14_descriptor_loss", "vox", f"""SELECT round(a + b, 6) AS total, round(a, 6) AS cross_entropy, round(b, 6) AS descriptor FROM (
    SELECT sum({NLL} * {WGT} * mask * scale) / sum(scale) AS a, sum({SQ} * {WGT} * mask * scale) / sum(scale) AS b FROM ({SCORED}))""")
def _(t):
    rows = _scored(t).withColumn("half", F.col("prob") / 2)
    return _r(loss.descriptor_loss(rows, SCORES, "lab_a", "scale", "mask", ["prob", "half"], ["raw", "inst"], [0.2, 0.8]), "total", "cross_entropy", "descriptor")


GDICE = """SELECT 1 - 2 * (i0 / (t0 * t0) + i1 / (t1 * t1)) / (d0 / (t0 * t0) + d1 / (t1 * t1)) AS loss FROM (
    SELECT sum(p0 * (1 - lab_a)) AS i0, sum(p1 * lab_a) AS i1, sum(p0 + 1 - lab_a) AS d0, sum(p1 + lab_a) AS d1, CAST(sum(1 - lab_a) AS DOUBLE) AS t0, CAST(sum(lab_a) AS DOUBLE) AS t1
    FROM (SELECT lab_a, 1 / (1 + exp(-s0)) AS p0, 1 / (1 + exp(-s1)) AS p1 FROM (SELECT *, 1.5 - prob AS s0, prob * 2 AS s1 FROM vox)))"""


@query("agg_15_ce_plus_dice", "vox", f"""SELECT round(a + b, 6) AS total, round(a, 6) AS cross_entropy, round(b, 6) AS dice FROM (
    SELECT (SELECT sum({NLL}) / count(*) FROM ({SCORED})) AS a, (SELECT loss FROM ({GDICE})) AS b)""")
def _(t):
    return _r(loss.ce_plus_dice(_scored(t), SCORES, "lab_a"), "total", "cross_entropy", "dice")


VAL = f"""SELECT y AS block, round(sum({NLL} * mask * scale) / sum(scale), 6) AS loss FROM ({SCORED}) GROUP BY y"""
VALJ = f"SELECT y, k, {JAC} AS j FROM " + _count_sql("SELECT y, lab_a AS t, CASE WHEN prob * 2 > 1.5 - prob THEN 1 ELSE 0 END AS p FROM vox WHERE mask <> 0", "y")


@query("agg_16_validate_predictions", "vox", f"""SELECT block, loss, round(a.j, 6) AS jaccard_0, round(b.j, 6) AS jaccard_1 FROM ({VAL})
    LEFT JOIN ({VALJ}) a ON a.y = block AND a.k = 0 LEFT JOIN ({VALJ}) b ON b.y = block AND b.k = 1""")
def _(t):
    rows = t.vox.withColumns({"s0": 1.5 - F.col("prob"), "s1": F.col("prob") * 2})
    out = jobs.validate_predictions(rows, ["y"], SCORES, "lab_a", "mask")
    return _r(out.withColumnRenamed("y", "block"), "loss", "jaccard_0", "jaccard_1")


# sampling ------------------------------------------------------------------------------------------------------------


@query("smp_01_sample_datasets", "vox", f"""
    SELECT i, (SELECT min(inst) FROM (SELECT inst, sum(count(*)) OVER (ORDER BY inst) / CAST(sum(count(*)) OVER () AS DOUBLE) AS u FROM vox GROUP BY inst) s WHERE s.u > d.u) AS dataset
    FROM (SELECT i, {draw_sql(17, "i")} AS u FROM (SELECT unnest(range(1000)) AS i)) d""")
def _(t):
    return sample.sample_datasets(t.vox.groupBy(F.col("inst").alias("dataset")).agg(F.count(F.lit(1)).alias("voxels")), 1000, 17)


@query("smp_02_possible_shifts", "boxes", """
    SELECT CAST(ceil(max(oz + 1) / 2.0) * 2 AS BIGINT) AS lo_z, CAST(floor(min(oz + sz + 8 - 3) / 2.0) * 2 + 1 AS BIGINT) AS hi_z, CAST(ceil(max(oy + 1) / 3.0) * 3 AS BIGINT) AS lo_y, CAST(floor(min(oy + sy + 300 - 3) / 3.0) * 3 + 1 AS BIGINT) AS hi_y,
           max(ox + 1) AS lo_x, min(ox + sx + 200 - 3) + 1 AS hi_x FROM boxes""")
def _(t):
    arrays = t.boxes.select(F.col("id").alias("array"), "oz", "oy", "ox", (F.col("sz") + 8).alias("sz"), (F.col("sy") + 300).alias("sy"), (F.col("sx") + 200).alias("sx"))
    request = t.boxes.select(F.col("id").alias("array"), *[F.lit(-1).alias(f"o{a}") for a in "zyx"], *[F.lit(4).alias(f"s{a}") for a in "zyx"])
    out = sample.possible_shifts(arrays, request, (2, 3, 1))
    return out.select([F.col(c).cast("long").alias(c) for c in out.columns])


@query("smp_03_random_locations", "vox", "SELECT i, " + ", ".join(f"CAST({lo} + floor({draw_sql(40 + k, 'i')} * ceil(({hi} - {lo}) / CAST({g} AS DOUBLE))) * {g} AS BIGINT) AS {a}" for k, (a, lo, hi, g) in enumerate((("z", 0, 7, 2), ("y", 0, "h", 3), ("x", 10, 90, 1)))) + f" FROM (SELECT unnest(range(500)) AS i), (SELECT {HEIGHT} AS h)")
def _(t):
    s = t.vox.agg(F.lit(0).alias("lo_z"), F.lit(7).alias("hi_z"), F.lit(0).alias("lo_y"), (F.max("y") + 1).alias("hi_y"), F.lit(10).alias("lo_x"), F.lit(90).alias("hi_x"))
    return sample.random_locations(s, 500, (2, 3, 1), 40)


DENSE = "(SELECT g.z, g.y, g.x, coalesce(v.mask, 0) AS mask FROM grid g LEFT JOIN vox v ON v.z = g.z AND v.y = g.y AND v.x = g.x)"


def _dense(t):
    return t.grid.join(t.vox.select(*KEY, "mask"), KEY, "left").select(*KEY, F.coalesce("mask", F.lit(0)).alias("mask"))


@query("smp_04_integral", "grid vox", _sel(f"""WITH a AS (SELECT z, y, x, sum(mask) OVER (PARTITION BY z, y ORDER BY x) AS s FROM {DENSE}),
    b AS (SELECT z, y, x, sum(s) OVER (PARTITION BY z, x ORDER BY y) AS s FROM a)
    SELECT z, y, x, CAST(sum(s) OVER (PARTITION BY y, x ORDER BY z) AS BIGINT) AS total FROM b"""))
def _(t):
    return sample.integral(_dense(t))


@query("smp_05_masked_ratio", "boxes vox", """
    SELECT b.id, round(coalesce(sum(v.mask), 0) / CAST(any_value(b.sz * b.sy * b.sx) AS DOUBLE), 6) AS ratio FROM (SELECT * FROM boxes WHERE oy + sy <= (SELECT max(y) + 1 FROM vox)) b
    LEFT JOIN vox v ON v.z >= oz AND v.z < oz + sz AND v.y >= oy AND v.y < oy + sy AND v.x >= ox AND v.x < ox + sx GROUP BY b.id""")
def _(t):
    top = _box(t)[1][1]
    return _r(sample.masked_ratio(t.boxes.filter(F.col("oy") + F.col("sy") <= top), sample.integral(_dense(t))), "ratio").select("id", "ratio")


def _summed(t):
    box = _box(t)
    return block_sums.integral_blocks(B.voxels_to_blocks(_dense(t), *box, CHUNK, "uint8", value="mask")), box


SUMMED = _sel(f"""WITH a AS (SELECT z, y, x, sum(mask) OVER (PARTITION BY z, y ORDER BY x) AS s FROM {DENSE}),
    b AS (SELECT z, y, x, sum(s) OVER (PARTITION BY z, x ORDER BY y) AS s FROM a)
    SELECT z, y, x, CAST(sum(s) OVER (PARTITION BY y, x ORDER BY z) AS BIGINT) AS total FROM b""")


@query("smp_04_integral_blocks", "grid vox", SUMMED)
def _(t):
    return B.blocks_to_voxels(_summed(t)[0], "long").withColumnRenamed("v", "total")


@query("smp_05_masked_ratio_blocks", "boxes vox", """
    SELECT b.id, round(coalesce(sum(v.mask), 0) / CAST(any_value(b.sz * b.sy * b.sx) AS DOUBLE), 6) AS ratio FROM (SELECT * FROM boxes WHERE oy + sy <= (SELECT max(y) + 1 FROM vox)) b
    LEFT JOIN vox v ON v.z >= oz AND v.z < oz + sz AND v.y >= oy AND v.y < oy + sy AND v.x >= ox AND v.x < ox + sx GROUP BY b.id""")
def _(t):
    table, box = _summed(t)
    return _r(block_sums.masked_ratio_blocks(t.boxes.filter(F.col("oy") + F.col("sy") <= box[1][1]), table, box, CHUNK), "ratio").select("id", "ratio")


RATIO = "(SELECT y * 100 + x AS i, avg(CASE WHEN lab_a > 0 THEN 1 ELSE 0 END) AS ratio FROM vox GROUP BY 1)"


@query("smp_06_accept_location", "vox", f"SELECT i, round(ratio, 6) AS ratio FROM (SELECT * FROM {RATIO} WHERE ratio >= 0.4 OR {draw_sql(23, 'i')} >= 0.9 ORDER BY i LIMIT 400)")
def _(t):
    rows = t.vox.groupBy((F.col("y") * 100 + F.col("x")).alias("i")).agg(F.avg((F.col("lab_a") > 0).cast("int")).alias("ratio"))
    return _r(sample.first_accepted(sample.accept_location(rows, 0.4, 0.9, 23), 400), "ratio")


@query("smp_07_reject", "vox points", f"""SELECT y, c, round(ratio, 6) AS ratio FROM (SELECT y, x // 10 AS c, avg(CASE WHEN mask > 0 THEN 1 ELSE 0 END) AS ratio FROM vox GROUP BY 1, 2)
    WHERE (ratio > 0.6 OR {draw_sql(29, "y", "c")} > 0.9) AND (y, c) IN (SELECT (y, x // 10) FROM points)""")
def _(t):
    rows, pts = (d.withColumn("c", F.expr("x DIV 10")) for d in (t.vox, t.points))
    return _r(sample.reject(rows, ["y", "c"], "mask", 0.6, 0.9, 29, pts), "ratio")


@query("smp_08_point_locations", "points", _sel(f"""WITH b AS (SELECT i, z - CAST(floor({draw_sql(32, "i")} * 3) AS BIGINT) AS z, y - CAST(floor({draw_sql(33, "i")} * 9) AS BIGINT) AS y, x - CAST(floor({draw_sql(34, "i")} * 20) AS BIGINT) AS x
        FROM (SELECT i, CAST(floor({draw_sql(31, "i")} * (SELECT count(*) FROM points)) AS BIGINT) + 1 AS r FROM (SELECT unnest(range(600)) AS i))
        JOIN (SELECT *, row_number() OVER (ORDER BY id) AS r FROM points) USING (r)),
    n AS (SELECT i, b.z, b.y, b.x, count(p.id) AS n_points FROM b LEFT JOIN points p ON p.z >= b.z AND p.z < b.z + 3 AND p.y >= b.y AND p.y < b.y + 9 AND p.x >= b.x AND p.x < b.x + 20 GROUP BY 1, 2, 3, 4)
    SELECT * FROM n WHERE {draw_sql(40, "i")} * n_points < 1"""))
def _(t):
    return sample.point_locations(t.points, (3, 9, 20), 600, 31)


@query("smp_09_training_blocks")
def _(t):
    rows = t.vox.select(*KEY, F.col("prob").alias("raw"), F.col("lab_a").alias("label"), "mask")
    return jobs.build_training_blocks(rows, _box(t), (5, 5, 5), 40, 3, min_masked=0.1, reject_below=0.3)


@query("res_09_elastic_augment")
def _(t):
    blocks = B.voxels_to_blocks(t.vox, *_box(t), (7, 16, 50), "uint8", value="raw")
    return B.blocks_to_voxels(B.elastic_augment(blocks, 8, 1.0, (0.0, 1.5), 11), "int", skip=0)


@query("res_09_elastic_volume")
def _(t):
    box = _box(t)
    how = deform.Deformation((4, 16, 16), (0.5, 2.0, 2.0), (0.0, 1.5), 0.05, 2, 4, 11)
    return B.blocks_to_voxels(deform.deform_blocks(B.voxels_to_blocks(t.vox, *box, CHUNK, "uint8", value="raw"), box, CHUNK, how), "int", skip=0)


@query("res_09_section_shift", "vox grid", _sel(f"""
    WITH s AS (SELECT z, sum(CASE WHEN {draw_sql(27, "z")} < 0.6 THEN CAST(floor({draw_sql(28, "z")} * 5) AS BIGINT) - 2 ELSE 0 END) OVER (ORDER BY z) AS dy,
                      sum(CASE WHEN {draw_sql(27, "z")} < 0.6 THEN CAST(floor({draw_sql(29, "z")} * 5) AS BIGINT) - 2 ELSE 0 END) OVER (ORDER BY z) AS dx FROM (SELECT unnest(range(7)) AS z))
    SELECT g.z, g.y, g.x, v.raw AS v FROM grid g JOIN s ON g.z = s.z JOIN vox v ON v.z = g.z AND v.y = least(greatest(g.y + dy, 0), {HEIGHT} - 1) AND v.x = least(greatest(g.x + dx, 0), 99)"""))
def _(t):
    box = _box(t)
    how = deform.Deformation((32, 32, 32), (0.0, 0.0, 0.0), (0.0, 0.0), 0.6, 2, 4, 7)
    return B.blocks_to_voxels(deform.deform_blocks(B.voxels_to_blocks(t.vox, *box, CHUNK, "uint8", value="raw"), box, CHUNK, how), "int", skip=0)


# prediction ----------------------------------------------------------------------------------------------------------

PRED = f"(SELECT z, y, x, s0 / 100 AS s0, s1 / 100 AS s1 FROM {CONV})"
SCALED = [{o: w / 100 for o, w in taps.items()} for taps in (TAPS, TAPS2)]


def stencil_model():
    """The built-in test model: two stencils over a block with one voxel of context."""
    import numpy as np

    kernels = [B.convolve_kernel(TAPS, 0.5), B.convolve_kernel(TAPS2, -1.0)]
    return lambda a: np.stack([k(a) for k in kernels])


@query("prd_01_predict_blocks", "vox grid", """
    SELECT g.z, g.y, g.x, c.c, CAST(CASE c.c WHEN 0 THEN 4 * coalesce(v.raw, 0) + 2 * coalesce(a.raw, 0) - coalesce(b.raw, 0) + 3 * coalesce(p.raw, 0) + 0.5
           ELSE coalesce(d.raw, 0) - 2 * coalesce(e.raw, 0) - 1.0 END AS DOUBLE) AS v FROM grid g CROSS JOIN (VALUES (0), (1)) c(c)
    LEFT JOIN vox v ON v.z = g.z AND v.y = g.y AND v.x = g.x LEFT JOIN vox a ON a.z = g.z AND a.y = g.y AND a.x = g.x + 1 LEFT JOIN vox b ON b.z = g.z AND b.y = g.y + 1 AND b.x = g.x
    LEFT JOIN vox p ON p.z = g.z - 1 AND p.y = g.y AND p.x = g.x LEFT JOIN vox d ON d.z = g.z + 1 AND d.y = g.y + 1 AND d.x = g.x + 1 LEFT JOIN vox e ON e.z = g.z AND e.y = g.y AND e.x = g.x - 1""")
def _(t):
    box, chunk = _box(t), CHUNK
    blocks = B.voxels_to_blocks(t.vox, *box, chunk, "int32", value="raw")
    out = predict.predict_blocks(blocks, stencil_model, tuple(c + 2 for c in chunk), chunk, box, 2)
    return B.blocks_to_voxels(out, also="c int")


@query("prd_02_class_maps", "vox", f"SELECT z, y, x, 0 AS c, round(1 / (1 + exp(s1 - s0)), 6) AS p FROM {PRED} UNION ALL SELECT z, y, x, 1, round(1 / (1 + exp(s0 - s1)), 6) FROM {PRED}")
def _(t):
    maps, _ = jobs.predict_voxels(_raw(t), SCALED, [0.005, -0.01])
    return _r(maps, "p")


@query("prd_02_segmentation", "vox", f"SELECT s.z, s.y, s.x, CASE WHEN v.mask <> 0 AND s1 > s0 THEN 1 ELSE 0 END AS seg FROM {PRED} s JOIN vox v ON s.z = v.z AND s.y = v.y AND s.x = v.x")
def _(t):
    return jobs.predict_voxels(_raw(t), SCALED, [0.005, -0.01], t.vox)[1]


@query("prd_02_prediction_job", "vox", f"""
    SELECT 'prob_maps/class_0' AS "array", z, y, x, round(1 / (1 + exp((s1 - s0) / 100)), 4) AS v FROM {CONV} UNION ALL SELECT 'prob_maps/class_1', z, y, x, round(1 / (1 + exp((s0 - s1) / 100)), 4) FROM {CONV}
    UNION ALL SELECT 'segmentation', s.z, s.y, s.x, CASE WHEN v.mask <> 0 AND s1 > s0 THEN 1 ELSE 0 END FROM {CONV} s JOIN vox v ON s.z = v.z AND s.y = v.y AND s.x = v.x""")
def _(t):
    def model():
        run = stencil_model()
        return lambda a: run(a) / 100

    box = _box(t)
    raw, mask = (B.voxels_to_blocks(t.vox, *box, CHUNK, k, value=c) for c, k in (("raw", "int32"), ("mask", "uint8")))
    out = jobs.predict_arrays(raw, model, tuple(c + 2 for c in CHUNK), CHUNK, box, 2, scratch_path(t.spark, "predictions"), "run", mask)
    return _r(B.blocks_to_voxels(out, also="array string").join(t.vox.select(*KEY), KEY, "left_semi"), "v", digits=4)


#: Checkpoints of the stencil model: the second class's scores are moved by so much.
SWEEP = {1000: -60.0, 2000: 40.0, 3000: 140.0}


def _checkpoint(shift: float):
    def load():
        import numpy as np

        run = stencil_model()
        return lambda a: run(a) / 100 + np.array([0.0, shift / 100]).reshape(2, 1, 1, 1)

    return load


def _swept(t):
    box = _box(t)
    raw, mask = (B.voxels_to_blocks(t.vox, *box, CHUNK, k, value=c) for c, k in (("raw", "int32"), ("mask", "uint8")))
    models = {k: _checkpoint(s) for k, s in SWEEP.items()}
    return jobs.predict_sweep_arrays(raw, models, tuple(c + 2 for c in CHUNK), CHUNK, box, scratch_path(t.spark, "predictions"), "run", mask)


@query("prd_03_predict_sweep", "vox", " UNION ALL ".join(
    f"SELECT {k} AS iteration, 'prob_maps/class_1' AS \"array\", z, y, x, round(1 / (1 + exp((s0 - s1 - {s}) / 100)), 4) AS v FROM {CONV} "
    f"UNION ALL SELECT {k}, 'segmentation', c.z, c.y, c.x, CASE WHEN v.mask <> 0 AND s1 + {s} > s0 THEN 1 ELSE 0 END FROM {CONV} c JOIN vox v ON c.z = v.z AND c.y = v.y AND c.x = v.x" for k, s in SWEEP.items()))
def _(t):
    rows = B.blocks_to_voxels(_swept(t).filter("array != 'prob_maps/class_0'").withColumn("name", F.concat_ws(" ", "iteration", "array")), also="name string")
    name = F.split("name", " ")
    rows = rows.join(t.vox.select(*KEY), KEY, "left_semi").select(name[0].cast("int").alias("iteration"), name[1].alias("array"), *KEY, "v")
    return _r(rows, "v", digits=4)


@query("prd_03_sweep_scores", "vox", " UNION ALL ".join(f"""
    SELECT {k} AS iteration, c.c AS cls, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn,
           round(count(*) FILTER (t = c AND p = c) / CAST(count(*) FILTER (t = c OR p = c) AS DOUBLE), 6) AS jaccard
    FROM (SELECT v.lab_a AS t, CASE WHEN s1 + {s} > s0 THEN 1 ELSE 0 END AS p FROM {CONV} s JOIN vox v ON s.z = v.z AND s.y = v.y AND s.x = v.x WHERE v.mask <> 0), (VALUES (0), (1)) c(c) GROUP BY c.c""" for k, s in SWEEP.items()))
def _(t):
    box = _box(t)
    target, mask = (B.voxels_to_blocks(t.vox, *box, CHUNK, "uint8", value=c) for c in ("lab_a", "mask"))
    return _r(jobs.block_scores(_swept(t).filter("array = 'segmentation'"), target, mask, 2), "jaccard")


# run log -------------------------------------------------------------------------------------------------------------


@query("log_01_scalars", "runlog", "SELECT run_id, metric, step, value FROM runlog WHERE step % 3 = 0")
def _(t):
    return runlog.log_scalars(t.runlog.withColumn("step", F.col("step").cast("long")), 3)


@query("log_02_loss_increase", "runlog", "SELECT run_id, step, coalesce(lag(value) OVER (PARTITION BY run_id ORDER BY step) * 1.5 < value, false) AS jump FROM runlog")
def _(t):
    return runlog.loss_increase(t.runlog, 1.5).select("run_id", F.col("step").cast("long").alias("step"), "jump")


@query("log_03_latest_checkpoint", "ckpt", "SELECT run_id, max(CAST(regexp_extract(name, '_checkpoint_(\\d+)$', 1) AS BIGINT)) AS iteration FROM ckpt GROUP BY run_id")
def _(t):
    return runlog.latest_checkpoint(t.ckpt)


@query("log_04_pick_iteration", "runlog", """SELECT run_id, min_by(step, (value, step)) FILTER (metric = 'click') AS best_loss_step, max_by(step, (value, -step)) FILTER (metric = 'view') AS best_f1_step FROM runlog GROUP BY run_id""")
def _(t):
    out = runlog.pick_iteration(t.runlog, "click", "view")
    return out.select("run_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]])


@query("log_05_with_iteration", "runlog", "SELECT run_id, metric, step, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS iteration FROM runlog")
def _(t):
    return runlog.with_iteration(t.runlog, "run_id", "step").select("run_id", "metric", F.col("step").cast("long").alias("step"), "iteration")


@query("snk_05_snapshot", "runlog", """SELECT run_id, iteration, value FROM (SELECT run_id, step AS iteration, value, coalesce(lag(value) OVER (PARTITION BY run_id ORDER BY step) * 3 < value, false) AS jump FROM runlog)
    WHERE iteration % 10 = 0 OR jump""")
def _(t):
    rows = runlog.loss_increase(t.runlog, 3.0).withColumnRenamed("step", "iteration")
    return runlog.snapshot(rows, 10, F.col("jump")).select("run_id", F.col("iteration").cast("long").alias("iteration"), "value")


@query("snk_05_snapshot_arrays", "vox grid", """
    WITH l AS (SELECT z // 2 AS iteration, avg(prob) AS loss FROM vox GROUP BY 1)
    SELECT g.z // 2 AS iteration, round(l.loss, 6) AS loss, CAST(min(coalesce(v.raw, 0)) AS DOUBLE) AS lo, CAST(max(coalesce(v.raw, 0)) AS DOUBLE) AS hi, 8.0 AS x_nm, 4.0 AS resolution, count(*) AS n_voxels
    FROM grid g LEFT JOIN vox v ON g.z = v.z AND g.y = v.y AND g.x = v.x JOIN l ON l.iteration = g.z // 2
    WHERE g.z // 2 % 3 = 0 OR l.loss > (SELECT avg(loss) FROM l) GROUP BY 1, 2""".replace("WITH l AS", "SELECT * FROM (WITH l AS", 1) + ")")
def _(t):
    box = _box(t)
    dense = t.grid.join(t.vox.select(*KEY, "raw"), KEY, "left").select(*KEY, F.coalesce("raw", F.lit(0)).alias("raw"))
    blocks = B.voxels_to_blocks(dense, *box, (2, 64, 64), "int32", value="raw").withColumns({
        "iteration": F.col("cz"), "array": F.lit("raw"), "offset_nm": F.array(F.lit(0.0), F.lit(0.0), F.lit(8.0)), "resolution": F.array(*[F.lit(4.0)] * 3)})
    losses = t.vox.groupBy(F.expr("z DIV 2").alias("iteration")).agg(F.avg("prob").alias("loss"))
    mean = losses.agg(F.avg("loss")).first()[0]
    kept = runlog.snapshot_arrays(blocks, losses, scratch_path(t.spark, "snapshots"), 3, F.col("loss") > mean)
    whole = kept.groupBy(F.col("iteration").cast("long").alias("iteration"), F.round("loss", 6).alias("loss"), "lo", "hi", F.col("offset_nm")[2].alias("x_nm"), F.col("resolution")[0].alias("resolution"))
    return whole.agg(F.sum(F.col("sz") * F.col("sy") * F.col("sx")).alias("n_voxels"))


@query("blk_voxels_round_trip", "blk", """SELECT cz * 4 + i // 16 AS z, cy * 4 + i // 4 % 4 AS y, cx * 4 + i % 4 AS x, round(v, 6) AS v
    FROM (SELECT cz, cy, cx, unnest(range(64)) AS i, CAST(unnest(data) AS DOUBLE) AS v FROM blk)""")
def _(t):
    vox = t.blk.select("cz", "cy", "cx", F.posexplode("data").alias("i", "v"))
    vox = vox.select((F.col("cz") * 4 + F.expr("i DIV 16")).alias("z"), (F.col("cy") * 4 + F.expr("i DIV 4 % 4")).alias("y"), (F.col("cx") * 4 + F.expr("i % 4")).alias("x"), "v")
    top = t.blk.agg(F.max("cz")).first()[0]
    return _r(B.blocks_to_voxels(B.voxels_to_blocks(vox, (0, 0, 0), ((top + 1) * 4, 40, 40), (8, 16, 16), "float32", -9.0), skip=-9.0), "v")


@query("res_03_pyramid_mean_blocks", "blk", """SELECT (cz * 4 + i // 16) // 2 AS z, (cy * 4 + i // 4 % 4) // 2 AS y, (cx * 4 + i % 4) // 2 AS x, CAST(floor(sum(w) / 8) AS BIGINT) AS v
    FROM (SELECT cz, cy, cx, unnest(range(64)) AS i, CAST(floor(CAST(unnest(data) AS DOUBLE) * 1000) AS BIGINT) + 5000 AS w FROM blk) GROUP BY 1, 2, 3""")
def _(t):
    vox = t.blk.select("cz", "cy", "cx", F.posexplode("data").alias("i", "f"))
    vox = vox.select((F.col("cz") * 4 + F.expr("i DIV 16")).alias("z"), (F.col("cy") * 4 + F.expr("i DIV 4 % 4")).alias("y"), (F.col("cx") * 4 + F.expr("i % 4")).alias("x"), (F.floor(F.col("f").cast("double") * 1000) + 5000).alias("v"))
    box = (0, 0, 0), ((t.blk.agg(F.max("cz")).first()[0] + 1) * 4, 40, 40)
    level = block_sums.pyramid_blocks(B.voxels_to_blocks(vox, *box, (8, 16, 16), "int64"), box, (8, 16, 16), [2], "mean")[0]
    return B.blocks_to_voxels(level, "long", skip=0)
