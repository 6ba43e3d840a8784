"""The domain's roles over the test tables, as SQL that Spark and DuckDB both read. {name} stands for a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from trackweave.runtime import table

VIEWS = {
    # Cameras with a constant model, one per nation.
    "v_cameras": "SELECT CAST(n_nationkey AS INT) AS camera_id, 'SIMPLE_RADIAL' AS model, CAST(1000 + 10 * n_nationkey AS DOUBLE) AS f, CAST(500 AS DOUBLE) AS cx, CAST(500 AS DOUBLE) AS cy, CAST(n_regionkey AS DOUBLE) / 100 AS k1 FROM {nation}",
    "v_images": "SELECT CAST(s_suppkey AS INT) AS image_id, s_name AS name, CAST(s_nationkey AS INT) AS camera_id FROM {supplier}",
    "v_points3d": "SELECT p_partkey AS point3d_id, CAST(p_size % 10 - 5 AS DOUBLE) / 5 AS px, CAST(p_partkey % 7 - 3 AS DOUBLE) / 3 AS py, 10 + CAST(p_partkey % 100 AS DOUBLE) / 100 AS pz FROM {part}",
    "v_obs": "SELECT CAST(l_suppkey AS INT) AS image_id, l_partkey AS point3d_id, 500 + min(l_quantity) AS x, 500 + max(l_quantity) AS y FROM {lineitem} GROUP BY l_suppkey, l_partkey",
    # Poses of suppliers' images: a small turn about y and a shift, by the key.
    "v_poses": "SELECT CAST(s_suppkey AS INT) AS image_id, CAST(s_nationkey AS INT) AS camera_id, CAST(1 AS DOUBLE) AS qw, CAST(0 AS DOUBLE) AS qx, CAST(s_suppkey % 11 AS DOUBLE) / 100 AS qy, CAST(0 AS DOUBLE) AS qz, CAST(s_suppkey % 5 AS DOUBLE) / 10 AS tx, CAST(s_suppkey % 3 AS DOUBLE) / 10 AS ty, CAST(0 AS DOUBLE) AS tz FROM {supplier}",
    "v_patch": "SELECT CAST(0 AS INT) AS level, CONCAT('image', CAST(vec_id % 20 AS STRING)) AS image_name, CAST(vec_id AS INT) AS kp_id, CAST(4 AS INT) AS h, CAST(4 AS INT) AS w, CAST(4 AS INT) AS c, CAST(vec_id % 7 AS INT) AS x0, CAST(vec_id % 5 AS INT) AS y0, CAST(1 AS DOUBLE) / 2 AS sx, CAST(1 AS DOUBLE) / 4 AS sy, CAST(1 AS DOUBLE) AS upsampling, embedding AS data FROM {embeddings}",
    "v_err": "SELECT event_type AS scene, CAST(user_id % 3 AS INT) AS method, event_id, CAST(value AS DOUBLE) / 1000 AS error FROM {events}",
    "v_desc": "SELECT label AS track, vec_id AS obs, CAST(vec_id % 20 AS INT) AS image_id, CAST(vec_id AS INT) AS kp_id, embedding FROM {embeddings}",
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf, t) for t in set(re.findall(r"{(\w+)}", sql))})


def ctes(*names: str) -> str:
    """The views as common table expressions, for DuckDB."""
    return ", ".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n]).replace('AS STRING', 'AS VARCHAR')})" for n in names)
