"""Queries on projections, errors, uniqueness, recall, and the solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import geometry
from trackweave.functions.interpolation import Sampling
from trackweave.operators import adjust, evaluation, localize, views
from trackweave.operators.adjust import BundleSetup, KeypointOptions
from trackweave.operators.graph import ba_problem_labels
from trackweave.operators.sampling import sample_patches
from trackweave.operators.solver import Options
from trackweave.plans.views import ctes, view
from trackweave.runtime import table

THRESHOLDS = [0.001, 0.01, 0.05, 0.1]


def _place() -> tuple[list, list, list]:
    """Columns of quaternion, translation and point."""
    return tuple([F.col(c) for c in names] for names in (("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"), ("px", "py", "pz")))


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    """Observations with their point, pose and camera."""
    cameras = view(spark, sf, "v_cameras").select("camera_id", "model", F.array("f", "cx", "cy", "k1").alias("params"))
    return views.observation_rows(view(spark, sf, "v_obs"), view(spark, sf, "v_points3d"), view(spark, sf, "v_poses"), cameras)


def _with_error(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).withColumn("error", geometry.reprojection_error(F.col("model"), F.col("params"), *_place(), F.col("x"), F.col("y")))


def project_points(spark, sf):
    u, v = geometry.world_to_pixel(F.col("model"), F.col("params"), *_place())
    return _rows(spark, sf).select("image_id", "point3d_id", F.round(geometry.depth(*_place()), 6).alias("depth"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def reprojection_error(spark, sf):
    return _with_error(spark, sf).select("image_id", "point3d_id", F.round("error", 6).alias("error"))


def pose_errors(spark, sf):
    """Each pose against that of the next image id."""
    poses = view(spark, sf, "v_poses")
    other = poses.select((F.col("image_id") - 1).alias("image_id"), *[F.col(c).alias(f"o_{c}") for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    dt, dr = geometry.pose_error(*_place()[:2], [F.col(f"o_{c}") for c in ("qw", "qx", "qy", "qz")], [F.col(f"o_{c}") for c in ("tx", "ty", "tz")])
    return poses.join(other, "image_id").select("image_id", (F.round(dt, 6) + F.lit(0.0)).alias("dt"), (F.round(dr, 4) + F.lit(0.0)).alias("dr"))


def _correspondences(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_error(spark, sf)
    return rows.select(F.col("image_id").cast("string").alias("query"), F.col("point3d_id").cast("int").alias("pos"), (F.col("point3d_id") % 50).cast("int").alias("kp_id"), (F.col("point3d_id") % 70).alias("point3d_id"), F.round("error", 6).alias("error"))


def unique_inliers(spark, sf):
    rows = _correspondences(spark, sf).withColumn("inlier", F.col("error") < 300)
    return localize.unique_inliers(rows, "point3d_id").select("query", "pos", "point3d_id")


def unique_min_error(spark, sf):
    return localize.unique_min_error(_correspondences(spark, sf), "point3d_id").select("query", "pos", "point3d_id", "error")


def unique_min_error_two_keys(spark, sf):
    return localize.unique_min_error_two_keys(_correspondences(spark, sf)).select("query", "pos", "kp_id", "point3d_id", "error")


def best_cluster(spark, sf):
    """The scene with the most errors below 0.1 per method."""
    counts = view(spark, sf, "v_err").groupBy(F.col("method").cast("string").alias("query"), F.col("scene").alias("cluster")).agg(F.count_if(F.col("error") < 0.1).alias("num_inliers"))
    return localize.best_cluster(counts)


def recall_curve(spark, sf):
    return evaluation.recall_curve(view(spark, sf, "v_err"), ["scene", "method"]).select("scene", "method", "error", F.round("recall", 9).alias("recall"))


def auc_at_thresholds(spark, sf):
    return evaluation.auc_at(view(spark, sf, "v_err"), ["scene", "method"], THRESHOLDS).withColumn("auc", F.round("auc", 6))


def pooled_auc(spark, sf):
    return evaluation.pooled_auc(view(spark, sf, "v_err"), THRESHOLDS).withColumn("auc", F.round("auc", 6))


def ecdf(spark, sf):
    curve = evaluation.ecdf(view(spark, sf, "v_err"), ["method"], 0.5)
    return curve.select("method", F.round(F.col("threshold") * 99 / 0.5).cast("int").alias("step"), F.round("share", 9).alias("share"))


def scene_means(spark, sf):
    per_scene = view(spark, sf, "v_err").groupBy("scene", "method").agg(F.avg("error").alias("error"))
    return evaluation.scene_means(per_scene, ["method"], ["error"]).withColumn("error", F.round("error", 9))


def result_table(spark, sf):
    per_scene = view(spark, sf, "v_err").groupBy("scene", "method").agg((F.count_if(F.col("error") < 0.1) * 100).alias("n"))
    return evaluation.result_table(per_scene, ["scene"], "method", [0, 1, 2], "n").withColumnsRenamed({"0": "m0", "1": "m1", "2": "m2"})


def error_by_track_length(spark, sf):
    rows = _with_error(spark, sf).groupBy("point3d_id").agg(F.count(F.lit(1)).cast("int").alias("track_length"), F.round(F.min("error") / 1000, 9).alias("error"))
    return evaluation.error_by_track_length(rows, [0.01, 0.05]).withColumn("median_error", F.round("median_error", 9)).withColumns({"below_0_01": F.round("below_0_01", 9), "below_0_05": F.round("below_0_05", 9)})


# Solvers: rows only; the tests compare them with brute force and planted truth ---------------------------------------------------


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    """Observations moved to where their points project, so that adjustment has something to find."""
    u, v = geometry.world_to_pixel(F.col("model"), F.col("params"), *_place())
    return _rows(spark, sf).withColumns({"x": u, "y": v}).where(F.col("x").isNotNull())


def _off(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"px": F.col("px") + 0.05, "py": F.col("py") - 0.03, "pz": F.col("pz") + 0.08})


def _places(points: DataFrame, digits: int = 4) -> list:
    return [(F.round(c, digits) + F.lit(0.0)).alias(c) for c in ("px", "py", "pz")]


def ba_points_geometric(spark, sf):
    """Points moved off by 0.05 come back to where their observations put them."""
    moved = adjust.adjust_points(_off(_truth(spark, sf)), Options(loss_name="trivial", parameter_tolerance=1e-10))
    return moved.join(ba_problem_labels(view(spark, sf, "v_points3d")), "point3d_id").select("point3d_id", "problem", *_places(moved))


def _with_patches(rows: DataFrame) -> DataFrame:
    """A patch around each projection whose two channels say how far a place is from it, in tenths of pixels."""
    x0, y0 = F.floor("x").cast("int") - 4, F.floor("y").cast("int") - 4
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.array((k % 8 + x0 + 0.5 - F.col("x")) / 10, (F.floor(k / 8) + y0 + 0.5 - F.col("y")) / 10)))
    return rows.withColumns({"h": F.lit(8), "w": F.lit(8), "c": F.lit(2), "x0": x0, "y0": y0, "sx": F.lit(1.0), "sy": F.lit(1.0), "upsampling": F.lit(1.0), "data": data, "reference": F.array(F.lit(0.0), F.lit(0.0))})


def _moved_by_patches(spark, sf, kind: str) -> DataFrame:
    rows = _with_patches(_truth(spark, sf)).withColumns({"px": F.col("px") + 0.01, "py": F.col("py") - 0.008, "pz": F.col("pz") + 0.01})
    moved = adjust.adjust_points(rows, Options(loss_name="trivial", parameter_tolerance=1e-10), kind, Sampling(l2_normalize=False))
    return moved.select("point3d_id", *_places(moved))


def ba_points_feature_reference(spark, sf):
    """Points moved off come back to where the descriptors at their projections meet the reference."""
    return _moved_by_patches(spark, sf, "feature_reference")


def ba_points_costmaps(spark, sf):
    """Points moved off come back to where the sampled maps are zero."""
    return _moved_by_patches(spark, sf, "costmaps")


def ba_full_geometric(spark, sf):
    """Poses, cameras and points of the images of one nation, started off the truth: the refined poses."""
    rows = _truth(spark, sf).where("camera_id = 3").withColumns({"tx": F.col("tx") + 0.01 * (F.col("image_id") % 3), "px": F.col("px") + 0.01})
    setup = BundleSetup.gauge([r.image_id for r in view(spark, sf, "v_poses").where("camera_id = 3").select("image_id").collect()])
    poses, _, _, _ = adjust.bundle_adjust(rows, setup, Options(loss_name="trivial", max_iterations=6))
    return spark.createDataFrame([(int(i), *map(float, q), *map(float, t)) for i, (q, t) in poses.items()], "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")


def ba_poses(spark, sf):
    """Poses of all images, moved off and found again from the points they see; the points stay."""
    rows = _truth(spark, sf).withColumns({"tx": F.col("tx") + 0.01 * (F.col("image_id") % 3), "ty": F.col("ty") - 0.01})
    setup = BundleSetup(refine_points=False, refine_focal=False, refine_extra=False)
    poses, _, _, _ = adjust.bundle_adjust(rows, setup, Options(loss_name="trivial", max_iterations=20))
    table = [(int(i), *map(float, q * np.sign(q[0])), *map(float, t)) for i, (q, t) in poses.items()]
    found = spark.createDataFrame(table, "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    return found.select("image_id", *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])


def localized_queries(spark, sf):
    """Every image taken as a query: its pose found again from its observations."""
    rows = _truth(spark, sf).select(F.col("image_id").cast("string").alias("query"), F.col("point3d_id").alias("pos"), "point3d_id", "x", "y", "px", "py", "pz", "model", "params")
    found = localize.localize(rows)
    return found.select("query", "success", *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])


def _field(spark: SparkSession, sf: str) -> DataFrame:
    """A smooth patch per keypoint: sines of the place plus a shift by the key."""
    x, y = lambda k: k % 12, lambda k: F.floor(k / 12)
    dx, dy = (F.col("src") % 7 - 3) / 10, (F.col("src") % 5 - 2) / 10
    data = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(143)), lambda k: F.array(F.sin((x(k) + dx) * 0.25), F.cos((y(k) + dy) * 0.2), F.sin((x(k) + dx + y(k) + dy) * 0.15))))
    keys = view(spark, sf, "v_patch").select(F.col("kp_id").cast("bigint").alias("src"), "image_name", "x0", "y0", "sx", "sy", "upsampling")
    return keys.withColumns({"h": F.lit(12), "w": F.lit(12), "c": F.lit(3), "data": data, "dx": dx, "dy": dy, "x": (F.lit(5.5) + F.col("x0") + 0.5) / F.col("sx"), "y": (F.lit(5.5) + F.col("y0") + 0.5) / F.col("sy")})


def _keypoint_rows(patches: DataFrame) -> DataFrame:
    """Problems of two keypoints, of which the first stays: each even key with the one after it."""
    none = lambda kind: F.lit(None).cast(kind)
    heads = patches.select(F.floor(F.col("src") / 2).alias("problem"), F.lit(0).alias("kind"), "src", none("bigint").alias("dst"), none("double").alias("sim"), "x", "y", (F.col("src") % 2 == 0).alias("is_constant"), "h", "w", "c", "x0", "y0", "sx", "sy", "upsampling", "data")
    edges = patches.where("src % 2 = 0").select(F.floor(F.col("src") / 2).alias("problem"), F.lit(1).alias("kind"), "src", (F.col("src") + 1).alias("dst"), F.lit(1.0).alias("sim"))
    return heads.unionByName(edges, allowMissingColumns=True)


def ka_featuremetric(spark, sf):
    """Pairs of patches of noise, each keypoint started at its middle."""
    patches = view(spark, sf, "v_patch").withColumns({"src": F.col("kp_id").cast("bigint"), "x": (F.lit(2.0) + F.col("x0") + 0.5) / F.col("sx"), "y": (F.lit(2.0) + F.col("y0") + 0.5) / F.col("sy")})
    return adjust.adjust_keypoints(_keypoint_rows(patches), KeypointOptions()).drop("history")


def ka_smooth(spark, sf):
    """Pairs of patches of one smooth field, shifted against each other: where the second keypoint goes, in feature pixels from its start."""
    patches = _field(spark, sf)
    moved = adjust.adjust_keypoints(_keypoint_rows(patches), KeypointOptions(sampling=Sampling(l2_normalize=False)))
    back = moved.join(patches.select(F.col("src").alias("node_idx"), F.col("x").alias("ox"), F.col("y").alias("oy"), "sx", "sy"), "node_idx")
    return back.select("node_idx", (F.round((F.col("x") - F.col("ox")) * F.col("sx"), 1) + F.lit(0.0)).alias("dx"), (F.round((F.col("y") - F.col("oy")) * F.col("sy"), 1) + F.lit(0.0)).alias("dy"))


def ka_summary(spark, sf):
    per_problem = ka_featuremetric(spark, sf).groupBy("problem").agg(*[F.first(c).alias(c) for c in ("initial_cost", "final_cost", "num_residuals", "iterations")])
    return adjust.summary_totals(per_problem)


def qka(spark, sf):
    """Keypoints started off the place where their reference was sampled."""
    patches = view(spark, sf, "v_patch").withColumns({"x": (F.lit(1.8) + F.col("x0") + 0.5) / F.col("sx"), "y": (F.lit(1.6) + F.col("y0") + 0.5) / F.col("sy")})
    known = sample_patches(patches).select(F.col("kp_id"), F.array("descriptor").alias("references"))
    started = patches.withColumns({"x": F.col("x") + 0.4, "y": F.col("y") - 0.6, "query": F.col("image_name")})
    return localize.refine_query_keypoints(started.join(known, "kp_id"))


def qka_smooth(spark, sf):
    """Keypoints of a smooth field, started off the place where their reference was sampled: how far from it they end, in feature pixels."""
    patches = _field(spark, sf)
    known = sample_patches(patches.withColumn("kp_id", F.col("src").cast("int")), Sampling(l2_normalize=False)).select("kp_id", F.array("descriptor").alias("references"))
    started = patches.withColumns({"kp_id": F.col("src").cast("int"), "query": F.col("image_name"), "ox": F.col("x"), "oy": F.col("y"), "x": F.col("x") + 0.4, "y": F.col("y") - 0.6}).join(known, "kp_id")
    moved = localize.refine_query_keypoints(started, sampling=Sampling(l2_normalize=False)).select("query", "kp_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    away = lambda n, o, s: (F.round((F.col(n) - F.col(o)) * F.col(s), 3) + F.lit(0.0))
    return started.select("query", "kp_id", "ox", "oy", "sx", "sy").join(moved, ["query", "kp_id"]).select("query", "kp_id", away("nx", "ox", "sx").alias("dx"), away("ny", "oy", "sy").alias("dy"))


QUERIES = {f.__name__: f for f in (
    project_points, reprojection_error, pose_errors, unique_inliers, unique_min_error, unique_min_error_two_keys, best_cluster, recall_curve, auc_at_thresholds, pooled_auc, ecdf, scene_means, result_table,
    error_by_track_length, ba_points_geometric, ba_points_feature_reference, ba_points_costmaps, ba_full_geometric, ba_poses, localized_queries, ka_featuremetric, ka_smooth, ka_summary, qka, qka_smooth,
)}

_PROJECTED = f"""WITH {ctes("v_cameras", "v_points3d", "v_obs", "v_poses")},
j AS (SELECT o.image_id, o.point3d_id, o.x, o.y, p.px, p.py, p.pz, s.tx, s.ty, s.tz, s.qy / sqrt(1 + s.qy * s.qy) AS b, 1 / sqrt(1 + s.qy * s.qy) AS a, c.f, c.cx, c.cy, c.k1 FROM v_obs o JOIN v_points3d p USING (point3d_id) JOIN v_poses s USING (image_id) JOIN v_cameras c USING (camera_id)),
cam AS (SELECT *, (1 - 2 * b * b) * px + 2 * a * b * pz + tx AS ex, py + ty AS ey, (1 - 2 * b * b) * pz - 2 * a * b * px + tz AS ez FROM j),
uv AS (SELECT *, ex / ez AS m, ey / ez AS n FROM cam),
pix AS (SELECT *, f * m * (1 + k1 * (m * m + n * n)) + cx AS u, f * n * (1 + k1 * (m * m + n * n)) + cy AS v FROM uv),
err AS (SELECT *, sqrt((u - x) ** 2 + (v - y) ** 2) AS error FROM pix)"""
_CORR = f"""{_PROJECTED}, c AS (SELECT CAST(image_id AS VARCHAR) AS query, CAST(point3d_id AS INTEGER) AS pos, CAST(point3d_id % 50 AS INTEGER) AS kp_id, point3d_id % 70 AS point3d_id, round(error, 6) AS error FROM err)"""


_PLACES = f"WITH {ctes('v_points3d', 'v_obs')} SELECT DISTINCT point3d_id, round(px, 4) + 0.0 AS px, round(py, 4) + 0.0 AS py, round(pz, 4) + 0.0 AS pz FROM v_points3d JOIN v_obs USING (point3d_id)"
_POSES = ", ".join([f"round({v} / sqrt(1 + qy * qy), {{digits}}) + 0.0 AS {v}" for v in ("qw", "qx", "qy", "qz")] + [f"round({v}, {{digits}}) + 0.0 AS {v}" for v in ("tx", "ty", "tz")])


def _auc(keys: list[str], floor: float) -> str:
    """Area under each recall curve, by trapezoids over all sorted errors with the boundary rows."""
    k = ", ".join(keys)
    join = " AND ".join(f"a.{x} = b.{x}" for x in keys)
    values = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
    return f"""WITH {ctes("v_err")}, e AS (SELECT {k}, error, row_number() OVER (PARTITION BY {k} ORDER BY error) AS rank, count(*) OVER (PARTITION BY {k}) AS n FROM v_err),
base AS (SELECT {k}, n, count(*) FILTER (error <= {floor}::DOUBLE) AS met FROM e GROUP BY ALL),
pts AS (SELECT {k}, error, rank::DOUBLE / n AS recall, rank FROM e WHERE error > {floor}::DOUBLE UNION ALL SELECT {k}, 0, met::DOUBLE / n, -1 FROM base UNION ALL SELECT {k}, {floor}::DOUBLE, met::DOUBLE / n, 0 FROM base),
th AS (SELECT a.*, t.threshold FROM (SELECT DISTINCT {k} FROM base) a, (VALUES {values}) t(threshold)),
cut AS (SELECT {", ".join(f"b.{x}" for x in keys)}, b.threshold, a.error, a.recall, a.rank FROM pts a JOIN th b ON {join} WHERE a.error <= b.threshold),
tail AS (SELECT {k}, threshold, threshold AS error, max(recall) AS recall, 1e15 AS rank FROM cut GROUP BY {k}, threshold),
alls AS (SELECT * FROM cut UNION ALL SELECT * FROM tail),
steps AS (SELECT *, lag(error) OVER w AS e0, lag(recall) OVER w AS r0 FROM alls WINDOW w AS (PARTITION BY {k}, threshold ORDER BY rank))
SELECT {k}, threshold, round(100 * sum((error - e0) * (recall + r0) / 2) / threshold, 6) AS auc FROM steps GROUP BY {k}, threshold"""


ORACLE = {
    "project_points": f"{_PROJECTED} SELECT image_id, point3d_id, round(ez, 6) AS depth, round(u, 6) AS u, round(v, 6) AS v FROM pix",
    "reprojection_error": f"{_PROJECTED} SELECT image_id, point3d_id, round(error, 6) AS error FROM err",
    "pose_errors": f"""WITH {ctes("v_poses")}, p AS (SELECT image_id, 2 * atan2(qy, qw) AS angle, tx, ty, tz FROM v_poses),
c AS (SELECT image_id, angle, cos(angle) * tx - sin(angle) * tz AS X, ty AS Y, sin(angle) * tx + cos(angle) * tz AS Z FROM p)
SELECT a.image_id, round(sqrt((a.X - b.X) ** 2 + (a.Y - b.Y) ** 2 + (a.Z - b.Z) ** 2), 6) + 0.0 AS dt, round(degrees(abs(a.angle - b.angle)), 4) + 0.0 AS dr FROM c a JOIN c b ON b.image_id = a.image_id + 1""",
    "ba_points_geometric": f"WITH {ctes('v_points3d', 'v_obs')} SELECT DISTINCT point3d_id, point3d_id // 50 AS problem, round(px, 4) + 0.0 AS px, round(py, 4) + 0.0 AS py, round(pz, 4) + 0.0 AS pz FROM v_points3d JOIN v_obs USING (point3d_id)",
    "ba_points_feature_reference": _PLACES, "ba_points_costmaps": _PLACES,
    "ba_poses": f"WITH {ctes('v_poses')} SELECT image_id, {_POSES.format(digits=4)} FROM v_poses",
    "localized_queries": f"WITH {ctes('v_poses')} SELECT CAST(image_id AS VARCHAR) AS query, true AS success, {_POSES.format(digits=3)} FROM v_poses",
    "ka_smooth": "SELECT vec_id AS node_idx, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE ((vec_id - 1) % 7 - vec_id % 7)::DOUBLE / 10 END + 0.0 AS dx, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE ((vec_id - 1) % 5 - vec_id % 5)::DOUBLE / 10 END + 0.0 AS dy FROM embeddings",
    "qka_smooth": "SELECT 'image' || CAST(vec_id % 20 AS VARCHAR) AS query, CAST(vec_id AS INTEGER) AS kp_id, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy FROM embeddings",
    "unique_inliers": f"{_CORR} SELECT query, pos, point3d_id FROM c WHERE error < 300 QUALIFY row_number() OVER (PARTITION BY query, point3d_id ORDER BY pos) = 1",
    "unique_min_error": f"{_CORR} SELECT query, pos, point3d_id, error FROM c QUALIFY row_number() OVER (PARTITION BY query, point3d_id ORDER BY error, pos) = 1",
    "unique_min_error_two_keys": f"{_CORR}, once AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query, point3d_id ORDER BY error, pos) = 1) SELECT query, pos, kp_id, point3d_id, error FROM once QUALIFY row_number() OVER (PARTITION BY query, kp_id ORDER BY error, pos) = 1",
    "best_cluster": f"WITH {ctes('v_err')}, n AS (SELECT CAST(method AS VARCHAR) AS query, scene AS cluster, count(*) FILTER (error < 0.1::DOUBLE) AS num_inliers FROM v_err GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query ORDER BY num_inliers DESC, cluster) = 1",
    "recall_curve": f"WITH {ctes('v_err')} SELECT DISTINCT scene, method, error, round(count(*) OVER (PARTITION BY scene, method ORDER BY error)::DOUBLE / count(*) OVER (PARTITION BY scene, method), 9) AS recall FROM v_err",
    "auc_at_thresholds": _auc(["scene", "method"], -1.0).replace("UNION ALL SELECT scene, method, -1.0::DOUBLE, met::DOUBLE / n, 0 FROM base", ""),
    "pooled_auc": _auc(["method"], 0.001),
    "ecdf": f"WITH {ctes('v_err')} SELECT method, CAST(step AS INTEGER) AS step, round(avg(CASE WHEN error <= step * (0.5::DOUBLE / 99) THEN 1.0::DOUBLE ELSE 0 END), 9) AS share FROM v_err, range(100) r(step) GROUP BY 1, 2",
    "scene_means": f"WITH {ctes('v_err')}, s AS (SELECT scene, method, avg(error) AS error FROM v_err GROUP BY 1, 2) SELECT method, round(avg(error), 9) AS error, count(DISTINCT scene) AS scenes FROM s GROUP BY 1",
    "result_table": f"""WITH {ctes("v_err")}, s AS (SELECT scene, method, count(*) FILTER (error < 0.1::DOUBLE) * 100 AS n FROM v_err GROUP BY 1, 2)
SELECT scene, {", ".join(f"lpad(coalesce(format('{{:,.2f}}', max(n::DOUBLE) FILTER (method = {m})), '-'), 10, ' ') AS m{m}" for m in range(3))} FROM s GROUP BY 1""",
    "error_by_track_length": f"""{_PROJECTED}, r AS (SELECT point3d_id, CAST(count(*) AS INTEGER) AS n, round(min(error) / 1000, 9) AS error FROM err GROUP BY 1), k AS (SELECT least(n, 8) AS track_length, greatest(error, 0.002::DOUBLE) AS error FROM r)
SELECT track_length, count(*) AS points, round(quantile_cont(error, 0.5), 9) AS median_error, round(avg(CASE WHEN error < 0.01::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 9) AS below_0_01, round(avg(CASE WHEN error < 0.05::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 9) AS below_0_05 FROM k GROUP BY 1""",
}
