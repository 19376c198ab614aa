"""Point-field views over the star-schema tables, for the registered queries.

Each view is one SELECT that Spark and DuckDB both run; ``{e1}`` ... stand for
the embedding's components.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_points": """
        SELECT CAST(label AS BIGINT) AS item_id, vec_id AS point_id, CAST({e1} AS DOUBLE) AS x, CAST({e2} AS DOUBLE) AS y,
               CAST({e3} AS DOUBLE) AS z, LEAST(ABS(CAST({e4} AS DOUBLE)), 1.0) AS distance
        FROM embeddings""",
    "fx_faces": """
        SELECT * FROM (
          SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1 AS BIGINT) AS fid, point_id AS v0,
                 LEAD(point_id, 1) OVER (PARTITION BY item_id ORDER BY point_id) AS v1,
                 LEAD(point_id, 2) OVER (PARTITION BY item_id ORDER BY point_id) AS v2
          FROM fx_points) t
        WHERE v2 IS NOT NULL""",
    "fx_segments": """
        SELECT * FROM (
          SELECT item_id, point_id AS seg_id, x AS ax, y AS ay, z AS az,
                 LEAD(x) OVER (PARTITION BY item_id ORDER BY point_id) AS bx,
                 LEAD(y) OVER (PARTITION BY item_id ORDER BY point_id) AS by_,
                 LEAD(z) OVER (PARTITION BY item_id ORDER BY point_id) AS bz
          FROM fx_points) t
        WHERE bx IS NOT NULL""",
    "fx_curve_verts": """
        SELECT item_id, CAST(FLOOR(pos / 7) AS BIGINT) AS curve_id, point_id AS vid FROM (
          SELECT item_id, point_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1 AS pos FROM fx_points) a
        UNION ALL
        SELECT item_id, CAST(FLOOR(pos / 7) AS BIGINT) - 1 AS curve_id, point_id AS vid FROM (
          SELECT item_id, point_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1 AS pos FROM fx_points) b
        WHERE pos % 7 = 0 AND pos > 0""",
    "fx_curves": """
        SELECT DISTINCT item_id, curve_id,
               CASE curve_id % 5 WHEN 0 THEN 'Line' WHEN 1 THEN 'Circle' WHEN 2 THEN 'Ellipse' WHEN 3 THEN 'BSpline' ELSE 'Other' END AS type,
               curve_id % 2 = 0 AS sharp
        FROM fx_curve_verts""",
    "fx_surface_faces": "SELECT item_id, CAST(FLOOR(fid / 4) AS BIGINT) AS surf_id, fid FROM fx_faces",
    "fx_surfaces": """
        SELECT DISTINCT item_id, surf_id, CASE surf_id % 3 WHEN 0 THEN 'Plane' WHEN 1 THEN 'Cylinder' ELSE 'BSpline' END AS type
        FROM fx_surface_faces""",
    "fx_sharp_segments": """
        SELECT s.item_id, c.curve_id, s.seg_id, k.point_id AS va, k.next_id AS vb, s.ax, s.ay, s.az, s.bx, s.by_, s.bz
        FROM fx_segments s
        JOIN (SELECT item_id, point_id, LEAD(point_id) OVER (PARTITION BY item_id ORDER BY point_id) AS next_id, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY point_id) - 1) / 7) AS BIGINT) AS curve_id FROM fx_points) k
          ON k.item_id = s.item_id AND k.point_id = s.seg_id
        JOIN fx_curves c ON c.item_id = k.item_id AND c.curve_id = k.curve_id
        WHERE c.sharp""",
    "fx_plane_faces": """
        SELECT f.item_id, f.fid, f.v0, f.v1, f.v2
        FROM fx_faces f JOIN fx_surface_faces sf ON sf.item_id = f.item_id AND sf.fid = f.fid
        JOIN fx_surfaces s ON s.item_id = sf.item_id AND s.surf_id = sf.surf_id
        WHERE s.type = 'Plane'""",
    "fx_pairs": """
        SELECT l_suppkey AS item_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_discount, l_tax, l_quantity, l_extendedprice) AS BIGINT) AS sample_id,
               l_discount AS true_d, l_tax AS pred_d
        FROM lineitem""",
    "fx_votes": """
        SELECT l_suppkey % 10 AS item_id, l_partkey AS global_idx, l_orderkey % 16 AS patch_id,
               CAST(ROW_NUMBER() OVER (PARTITION BY l_suppkey % 10, l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_discount, l_tax, l_quantity, l_extendedprice) AS BIGINT) AS vote_id,
               l_discount * 10 AS value, l_quantity AS px, l_tax * 100 AS py, l_discount * 100 AS pz
        FROM lineitem""",
    "fx_flags": """
        SELECT o_orderkey AS patch_id, o_custkey AS item_id, o_orderstatus = 'F' AS has_sharp, o_orderkey % 7 = 0 AS has_smell_a,
               o_custkey % 5 = 0 AS has_smell_b, o_orderpriority = '1-URGENT' AS has_smell_c
        FROM orders""",
    "fx_pixel_hits": """
        SELECT event_type AS view_id, CAST(FLOOR(user_id / 16) AS BIGINT) AS pr, user_id % 16 AS pc, value AS depth, event_id
        FROM events""",
    "fx_pixels": """
        SELECT view_id, pr, pc, MIN(depth) AS depth, MIN(event_id) AS event_id FROM fx_pixel_hits GROUP BY view_id, pr, pc""",
    "fx_shards": "SELECT o_orderkey % 13 AS shard, o_orderkey AS row_id, o_totalprice AS payload FROM orders",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = re.sub(r"\{e(\d+)\}", r"element_at(embedding, \1)", VIEWS[name])
    used = {x: view(spark, sf_dir, x) for x in (*VIEWS, *TABLES) if x != name and re.search(rf"\b{x}\b", sql)}
    for x in used:
        sql = re.sub(rf"\b{x}\b", "{" + x + "}", sql)
    return spark.sql(sql, **used)


def duck(sql: str, *doubles: str) -> str:
    """DuckDB text: the views that ``sql`` needs, and ``doubles`` rounded to 6 digits."""
    order: list[str] = []

    def visit(text: str) -> None:
        for v in _needs(text):
            if v not in order:
                visit(VIEWS[v].replace(v, ""))
                if v not in order:
                    order.append(v)

    visit(sql)
    ctes = ", ".join(f"{v} AS ({re.sub(r'[{]e(\d+)[}]', r'embedding[\1]', VIEWS[v])})" for v in order)
    picked = "SELECT * REPLACE (" + ", ".join(f"ROUND(CAST({d} AS DOUBLE), 6) + 0.0::DOUBLE AS {d}" for d in doubles) + ")" if doubles else "SELECT *"
    body = f"{picked} FROM ({sql}) q"
    return (f"WITH {ctes} " if ctes else "") + body


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to 6 digits, as the oracle texts have them."""
    from pyspark.sql import functions as F

    return df.select(*(F.expr(f"round(`{c}`, 6) + 0.0D").alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
