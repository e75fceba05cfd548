"""Volume-shaped views over the star-schema tables, one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: {d} is integer division, {n} the number of shuffle partitions, {h} the height of the volume (largest y of vox and 1); views may use those before them.
VIEWS = {
    "vox": """
        SELECT l_linenumber - 1 AS z, l_orderkey {d} 100 AS y, l_orderkey % 100 AS x,
               CAST(max(l_quantity) AS INT) * 5 AS raw,
               CAST(round(max(l_discount) * 100) AS INT) / CAST(10 AS DOUBLE) AS prob,
               max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS lab_a,
               max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS lab_b,
               max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS mask,
               max(CASE WHEN l_tax > 0.02 THEN 1 ELSE 0 END) AS mmask,
               max(l_suppkey) % 20 AS inst, max(p_size) AS gt
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
        GROUP BY l_linenumber - 1, l_orderkey {d} 100, l_orderkey % 100""",
    "grid": {
        # made of a range, whose size Spark knows: what explode makes of a few rows it takes for as small as those, and broadcasts what is joined with it
        "spark": """
        SELECT CAST(id % 7 AS INT) AS z, id DIV 700 AS y, CAST(id DIV 7 % 100 AS INT) AS x FROM range(0, 700 * {h}, 1, {n})""",
        "duckdb": "SELECT a.z, b.y, c.x FROM (SELECT unnest(range(7)) AS z) a, (SELECT unnest(range((SELECT max(y) + 1 FROM vox))) AS y) b, (SELECT unnest(range(100)) AS x) c",
    },
    "blob": """
        SELECT g.z, g.y, g.x,
               CASE WHEN g.z BETWEEN 1 AND 5 AND g.y % 12 < 8 AND g.x % 12 < 9 AND coalesce(v.raw, 0) < 250
                    THEN 1 + (g.y {d} 12) * 9 + g.x {d} 12 ELSE 0 END AS id
        FROM grid g LEFT JOIN vox v ON g.z = v.z AND g.y = v.y AND g.x = v.x""",
    "chan": """
        SELECT z, y, x, 0 AS c, CAST(mask + lab_a AS DOUBLE) AS v FROM vox
        UNION ALL SELECT z, y, x, 1, lab_b + prob FROM vox
        UNION ALL SELECT z, y, x, 2, raw / CAST(250 AS DOUBLE) FROM vox""",
    "blk": """
        SELECT vec_id {d} 100 AS cz, (vec_id {d} 10) % 10 AS cy, vec_id % 10 AS cx, embedding AS data FROM embeddings""",
    "desc": {
        "spark": "SELECT vec_id, label AS target, pos AS c, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v",
        "duckdb": "SELECT vec_id, label AS target, unnest(range(64)) AS c, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings",
    },
    "boxes": """
        SELECT s_suppkey AS id, s_suppkey % 5 AS oz, (s_suppkey * 7) % h AS oy, (s_suppkey * 13) % 90 AS ox,
               2 AS sz, 3 + s_nationkey % 4 AS sy, 5 AS sx, s_nationkey % 5 AS organelle
        FROM supplier, (SELECT max(y) + 1 AS h FROM vox)""",
    "points": """
        SELECT c_custkey AS id, c_custkey % 7 AS z, (c_custkey * 31) % h AS y, (c_custkey * 17) % 100 AS x
        FROM customer, (SELECT max(y) + 1 AS h FROM vox)""",
    "sections": "SELECT 'sec_' || p_partkey || '.tif' AS name FROM part",
    "runlog": """
        SELECT user_id AS run_id, event_type AS metric,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value
        FROM events""",
    "ckpt": "SELECT 'model_checkpoint_' || event_id AS name, user_id AS run_id FROM events",
}
NEEDS = {"grid": ("vox",), "blob": ("vox", "grid"), "chan": ("vox",), "boxes": ("vox",), "points": ("vox",)}
TABLES = ("lineitem", "part", "supplier", "customer", "orders", "events", "embeddings")


def _text(name: str, engine: str) -> str:
    v = VIEWS[name]
    return (v if isinstance(v, str) else v[engine]).replace("{d}", "DIV" if engine == "spark" else "//")


def _order(names: tuple[str, ...]) -> list[str]:
    wanted = {m for n in names for m in (*NEEDS.get(n, ()), n)}
    return [n for n in VIEWS if n in wanted]


def oracle(views: tuple[str, ...], body: str) -> str:
    """``body`` with the views as common table expressions."""
    parts = [f'"{n}" AS ({_text(n, "duckdb")})' for n in _order(views)]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables in ``sf_dir``."""
    have: dict[str, DataFrame] = {}

    def text_of(n: str) -> DataFrame:
        if n not in have:
            tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in _text(n, "spark")}
            views = {m: text_of(m) for m in NEEDS.get(n, ())}
            text = _text(n, "spark").replace("{n}", spark.conf.get("spark.sql.shuffle.partitions"))
            if "{h}" in text:
                text = text.replace("{h}", str(views["vox"].agg(F.coalesce(F.max("y") + 1, F.lit(0))).first()[0]))
            for t in (*tables, *views):
                text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
            have[n] = spark.sql(text, **tables, **views)
        return have[n]

    return text_of(name)
