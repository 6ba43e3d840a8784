"""Queries on descriptors, patches, references and cost maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackweave.functions import arrays, ids, losses
from trackweave.functions.interpolation import Sampling
from trackweave.operators import costmaps, references, sampling
from trackweave.plans.views import ctes, view
from trackweave.runtime import table
from trackweave.sources import tables


def _text(column: str, digits: int = 6):
    """An array of doubles as text, so that engines compare digits."""
    return F.array_join(F.transform(column, lambda v: F.format_string(f"%.{digits}f", F.round(v, digits) + F.lit(0.0))), " ")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """Patches with a place to sample, inside and outside, in image coordinates."""
    patches = view(spark, sf, "v_patch")
    u, v = (F.col("kp_id") % 9 - 1) * 0.56 + 0.25, (F.col("kp_id") % 11 - 1) * 0.4 + 0.15
    return patches.withColumns({"x": ids.to_image(u, F.col("sx"), F.col("x0"), F.col("upsampling")), "y": ids.to_image(v, F.col("sy"), F.col("y0"), F.col("upsampling"))})


def _grid(frame: DataFrame) -> DataFrame:
    return frame.withColumns({"u": F.round(ids.to_pixel(F.col("x"), F.col("sx"), F.col("x0"), F.col("upsampling")), 9), "v": F.round(ids.to_pixel(F.col("y"), F.col("sy"), F.col("y0"), F.col("upsampling")), 9)})


def _by_sampler(spark: SparkSession, sf: str, how: Sampling) -> DataFrame:
    return sampling.sample_patches(_places(spark, sf), how).select("kp_id", _text("descriptor").alias("descriptor"))


def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", _text(arrays.l2_normalised(F.col("embedding"))).alias("unit"))


def ncc_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", _text(arrays.ncc_normalised(F.col("embedding"), 4)).alias("unit"))


def cosine_scores(spark, sf):
    """Every descriptor against the first of its label."""
    desc = view(spark, sf, "v_desc")
    first = desc.groupBy("track").agg(F.min("obs").alias("src"), F.min_by("embedding", "obs").alias("first"))
    return desc.join(first, "track").select("src", F.col("obs").alias("dst"), (F.round(arrays.cosine(F.col("first"), F.col("embedding")), 6) + F.lit(0.0)).alias("cosine"))


def corner_boxes(spark, sf):
    """Both corner rules and the interval of motion, per observation."""
    obs = view(spark, sf, "v_obs")
    scale, size = F.lit(0.5), F.lit(500)
    corner = ids.extraction_corner(F.col("x"), scale, 16, size)
    low, high = ids.keypoint_bounds(F.col("x"), corner, F.lit(16.0), scale, 4.0)
    return obs.select("image_id", "point3d_id", ids.to_centre_origin(F.col("x")).alias("x_centre"), ids.clamped_corner(F.col("x") * scale - 0.5, 16, size).alias("corner_a"), corner.alias("corner_b"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def scaled_sizes(spark, sf):
    w, h = ids.scaled_size(F.col("width"), F.col("height"), 1600, 0.5)
    return table(spark, sf, "cameras").select("camera_id", w.alias("w"), h.alias("h")).distinct()


def bilinear_sample(spark, sf):
    values = [arrays.bilinear(F.col("data"), F.col("h"), F.col("w"), F.col("c"), F.col("u"), F.col("v"), k) for k in range(4)]
    return _grid(_places(spark, sf)).select("kp_id", *[(F.round(value, 6) + F.lit(0.0)).alias(f"c{k}") for k, value in enumerate(values)])


def nearest_sample(spark, sf):
    values = [arrays.nearest(F.col("data"), F.col("h"), F.col("w"), F.col("c"), F.col("u"), F.col("v"), k) for k in range(4)]
    return _grid(_places(spark, sf)).select("kp_id", *[(F.round(value, 6) + F.lit(0.0)).alias(f"c{k}") for k, value in enumerate(values)])


def bicubic_sample(spark, sf):
    return _by_sampler(spark, sf, Sampling(l2_normalize=False))


def bicubic_nodes_ncc(spark, sf):
    return _by_sampler(spark, sf, Sampling(l2_normalize=False, ncc_normalize=True, nodes=((-0.5, -0.5), (0.5, -0.5), (-0.5, 0.5), (0.5, 0.5))))


def gradient_field_sample(spark, sf):
    return _by_sampler(spark, sf, Sampling(mode="BICUBICGRADIENTFIELD", l2_normalize=False))


def patch_slice(spark, sf):
    cut = sampling.slice_patches(_places(spark, sf), 2)
    return cut.select("kp_id", "x0", "y0", "h", "w", _text("data").alias("data"))


def robust_costs(spark, sf):
    """Loss values of the squared distance of each descriptor to the first of its label."""
    desc = view(spark, sf, "v_desc")
    first = desc.groupBy("track").agg(F.min_by("embedding", "obs").alias("reference"))
    s = arrays.squared_distance(F.col("embedding"), F.col("reference"))
    return desc.join(first, "track").withColumn("s", s).select("track", "obs", *[(F.round(losses.rho(name, F.col("s")), 6) + F.lit(0.0)).alias(name) for name in losses.NAMES])


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """A track per label: few and long ones, which the reweighted mean takes whole."""
    desc = view(spark, sf, "v_desc")
    position = F.row_number().over(Window.partitionBy("track").orderBy("obs")).cast("int")
    return desc.select(F.lit(0).alias("level"), F.col("track").cast("bigint").alias("point3d_id"), position.alias("track_pos"), "image_id", "kp_id", F.col("embedding").cast("array<double>").alias("descriptor"))


def _extracted(spark: SparkSession, sf: str, **more) -> DataFrame:
    return references.extract_references(_observed(spark, sf), iterations=3, l2=False, **more)


def robust_mean_irls(spark, sf):
    return _extracted(spark, sf, keep_observations=False).select("point3d_id", _text("mean").alias("mean"))


def reference_source(spark, sf):
    return _extracted(spark, sf, keep_observations=False).select("point3d_id", "src_image_id", "src_kp_id")


def reference_observations(spark, sf):
    return _extracted(spark, sf).select("point3d_id", F.explode("observations").alias("o")).select("point3d_id", "o.track_pos", "o.kp_id", (F.round("o.cost", 6) + F.lit(0.0)).alias("cost"))


def nearest_reference(spark, sf):
    """For every observation, the nearest of the observations of the track that follows its own."""
    queries = view(spark, sf, "v_desc").select(F.col("image_id").cast("string").alias("query"), F.col("kp_id").alias("pos"), ((F.col("track") + 1) % 10).cast("bigint").alias("point3d_id"), F.col("embedding").cast("array<double>").alias("descriptor"))
    return references.nearest_references(queries, _extracted(spark, sf)).select("query", "pos", "point3d_id", "src_kp_id")


def stored_references(spark, sf):
    """Of each stored reference, the observation of least cost by its parallel lists; repeated rows once."""
    rows = table(spark, sf, "point_references").where(F.size("costs") == F.size("track_list_image_id")).select("level", "point3d_id", "costs", "track_list_image_id", "track_list_point2d_idx").dropDuplicates(["level", "point3d_id"])
    zipped = rows.select("level", "point3d_id", F.posexplode(F.arrays_zip("costs", "track_list_image_id", "track_list_point2d_idx")).alias("pos", "o"))
    good = zipped.where(F.col("o.costs").isNotNull() & ~F.isnan("o.costs") & (F.col("o.track_list_image_id") >= 0) & (F.col("o.track_list_point2d_idx") >= 0))
    best = F.min_by(F.struct(F.col("o.track_list_image_id").alias("image_id"), F.col("o.track_list_point2d_idx").alias("kp_id")), F.struct("o.costs", "pos")).alias("b")
    return good.groupBy("level", "point3d_id").agg(best).select("level", "point3d_id", "b.image_id", "b.kp_id")


def costmap_cost(spark, sf):
    """The cost of every pixel against the patch's first pixel."""
    patches = view(spark, sf, "v_patch")
    costs = costmaps.pixel_costs(F.col("data"), F.slice("data", 1, 4), F.col("h"), F.col("w"), 4)
    return patches.select("kp_id", _text(costs).alias("costs"))


def costmap_gradients(spark, sf):
    patches = view(spark, sf, "v_patch").withColumn("reference", F.slice("data", 1, 4).cast("array<double>"))
    return costmaps.extract_costmaps(patches).select("kp_id", "h", "w", "c", _text("data", 4).alias("data"))


def scored_matches(spark, sf):
    """Matches of both images' stored descriptors with their cosine; 1 where one is missing."""
    once = table(spark, sf, "pair_matches").select("pair_ord", "pair_id", "stored_reversed", "matches0", "matching_scores0").dropDuplicates(["pair_ord"])
    matches = tables.decode_pair_matches(once).select(ids.pair_id(F.col("image1"), F.col("image2")).alias("pair_id"), "match_ord", "kp1", "kp2")
    return tables.score_matches(matches, table(spark, sf, "descriptors").where(F.col("image_id").isNotNull())).withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (
    l2_normalize, ncc_normalize, cosine_scores, corner_boxes, scaled_sizes, bilinear_sample, nearest_sample, bicubic_sample, bicubic_nodes_ncc, gradient_field_sample, patch_slice, robust_costs, robust_mean_irls,
    reference_source, reference_observations, nearest_reference, stored_references, costmap_cost, costmap_gradients, scored_matches,
)}


def _sql_text(values: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({values}, lambda v: printf('%.{digits}f', round(v, {digits}) + 0.0)), ' ')"


_AT = "(kp_id % 9 - 1) * 0.56::DOUBLE + 0.25::DOUBLE AS u, (kp_id % 11 - 1) * 0.4::DOUBLE + 0.15::DOUBLE AS v"
_READ = "CAST(data[CAST((least(greatest({r}, 0), 3) * 4 + least(greatest({c}, 0), 3)) * 4 + {k} + 1 AS INTEGER)] AS DOUBLE)"


def _at(r: str, c: str) -> str:
    return f"CAST(data[CAST((({r}) * 4 + ({c})) * 4 + ch + 1 AS INTEGER)] AS DOUBLE)"


def _bilinear(k: int) -> str:
    at = lambda dr, dc: _READ.format(r=f"(floor(v) + {dr})", c=f"(floor(u) + {dc})", k=k)
    return f"round(({at(0, 0)} * (1 - (u - floor(u))) + {at(0, 1)} * (u - floor(u))) * (1 - (v - floor(v))) + ({at(1, 0)} * (1 - (u - floor(u))) + {at(1, 1)} * (u - floor(u))) * (v - floor(v)), 6) + 0.0 AS c{k}"


def _spline(p: list[str], x: str) -> str:
    a, b, c, d = p
    return f"({b} + {x} * (({c} - {a}) / 2 + {x} * ((2 * {a} - 5 * {b} + 4 * {c} - {d}) / 2 + {x} * (3 * ({b} - {c}) + {d} - {a}) / 2)))"


def _bicubic(k: int) -> str:
    rows = [_spline([_READ.format(r=f"(floor(v) + {dr})", c=f"(floor(u) + {dc})", k=k) for dc in range(-1, 3)], "(u - floor(u))") for dr in range(-1, 3)]
    return _spline(rows, "(v - floor(v))")


_HERMITE = ["(2 * {x} ** 3 - 3 * {x} ** 2 + 1)", "(3 * {x} ** 2 - 2 * {x} ** 3)", "({x} ** 3 - 2 * {x} ** 2 + {x})", "({x} ** 3 - {x} ** 2)"]


def _gradient_field() -> str:
    """The bicubic surface of a cell by values (channel 0), slopes down (1) and along (2), and cross slopes (3) at its corners."""
    weight = lambda at, slope, x: _HERMITE[2 * slope + at].format(x=x)
    return " + ".join(
        f"{weight(i, down, '(v - floor(v))')} * {weight(j, along, '(u - floor(u))')} * {_READ.format(r=f'(floor(v) + {i})', c=f'(floor(u) + {j})', k=down + 2 * along)}"
        for i in (0, 1) for j in (0, 1) for down in (0, 1) for along in (0, 1)
    )


_BYTE = "CAST(('0x' || substr({h}, CAST(256 * {kp} + 2 * k + 1 AS BIGINT), 2)) AS INTEGER)"
_D2 = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) ** 2))"
_CAUCHY = "(0.0625::DOUBLE * ln(1 + {s} / 0.0625::DOUBLE))"


def _irls() -> str:
    """Three unrolled passes of the reweighted mean."""
    mean = "SELECT track, list(m ORDER BY i) AS mean FROM (SELECT d.track, i, sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w) AS m FROM {w} d, range(1, 65) r(i) GROUP BY d.track, i) GROUP BY track"
    weight = "SELECT d.track, d.obs, d.embedding, 1 / " + _CAUCHY.format(s=_D2.format(a="d.embedding", b="m.mean")) + " AS w FROM v_desc d JOIN {m} m ON m.track = d.track"
    steps = [f"w1 AS (SELECT track, obs, embedding, 1.0::DOUBLE AS w FROM v_desc), m1 AS ({mean.format(w='w1')})"]
    for k in (2, 3):
        steps.append(f"w{k} AS ({weight.format(m=f'm{k - 1}')}), m{k} AS ({mean.format(w=f'w{k}')})")
    return ", ".join(steps)


_SOURCE = f"""WITH {ctes("v_desc")}, {_irls()}, far AS (SELECT d.*, {_D2.format(a="d.embedding", b="m.mean")} AS s, row_number() OVER (PARTITION BY d.track ORDER BY d.obs) AS track_pos FROM v_desc d JOIN m3 m ON m.track = d.track),
src AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY s, track_pos) AS rank FROM far)"""

ORACLE = {
    "l2_normalize": f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS size FROM e), u AS (SELECT vec_id, list_transform(x, lambda v: v / size) AS y FROM n) SELECT vec_id, {_sql_text('y')} AS unit FROM u",
    "ncc_normalize": f"""WITH v AS (SELECT vec_id, i // 4 AS node, i % 4 AS c, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(i)),
s AS (SELECT vec_id, c, avg(x) AS m, stddev_pop(x) AS d FROM v GROUP BY 1, 2), u AS (SELECT v.vec_id, list((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END ORDER BY node, v.c) AS y FROM v JOIN s ON s.vec_id = v.vec_id AND s.c = v.c GROUP BY 1) SELECT vec_id, {_sql_text('y')} AS unit FROM u""",
    "cosine_scores": f"WITH {ctes('v_desc')}, d AS (SELECT track, obs, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM v_desc), f AS (SELECT track, min(obs) AS src, arg_min(x, obs) AS a FROM d GROUP BY 1) SELECT f.src, d.obs AS dst, round(list_cosine_similarity(f.a, d.x), 6) + 0.0 AS cosine FROM d JOIN f ON f.track = d.track",
    "corner_boxes": f"""WITH {ctes("v_obs")}, b AS (SELECT image_id, point3d_id, x, CAST(least(greatest(trunc(x / 2 - 8), 0), 483) AS INTEGER) AS corner_b FROM v_obs)
SELECT image_id, point3d_id, x - 0.5 AS x_centre, CAST(least(greatest(trunc(x / 2 - 0.5 - 8), 0), 484) AS INTEGER) AS corner_a, corner_b, round(greatest((corner_b + 0.5::DOUBLE) * 2, x - 8), 6) AS low, round(least((corner_b + 0.5::DOUBLE) * 2 + 32, x + 8), 6) AS high FROM b""",
    "scaled_sizes": "SELECT DISTINCT camera_id, CAST(round_even(width * (least(1600::DOUBLE / greatest(width, height), 1) * 0.5::DOUBLE), 0) AS INTEGER) AS w, CAST(round_even(height * (least(1600::DOUBLE / greatest(width, height), 1) * 0.5::DOUBLE), 0) AS INTEGER) AS h FROM cameras",
    "bilinear_sample": f"WITH {ctes('v_patch')}, p AS (SELECT kp_id, data, {_AT} FROM v_patch) SELECT kp_id, {', '.join(map(_bilinear, range(4)))} FROM p",
    "nearest_sample": f"WITH {ctes('v_patch')}, p AS (SELECT kp_id, data, {_AT} FROM v_patch) SELECT kp_id, {', '.join('round(' + _READ.format(r='round(v)', c='round(u)', k=k) + f', 6) + 0.0 AS c{k}' for k in range(4))} FROM p",
    "bicubic_sample": f"WITH {ctes('v_patch')}, p AS (SELECT kp_id, data, {_AT} FROM v_patch), s AS (SELECT kp_id, [{', '.join(map(_bicubic, range(4)))}] AS d FROM p) SELECT kp_id, {_sql_text('d')} AS descriptor FROM s",
    "bicubic_nodes_ncc": f"""WITH {ctes("v_patch")}, p AS (SELECT kp_id, data, {_AT} FROM v_patch), n AS (SELECT kp_id, data, node, u + dx AS u, v + dy AS v FROM p, (VALUES (0, -0.5::DOUBLE, -0.5::DOUBLE), (1, 0.5::DOUBLE, -0.5::DOUBLE), (2, -0.5::DOUBLE, 0.5::DOUBLE), (3, 0.5::DOUBLE, 0.5::DOUBLE)) t(node, dx, dy)),
s AS (SELECT kp_id, node, unnest([{', '.join(map(_bicubic, range(4)))}]) AS x, unnest(range(4)) AS ch FROM n), m AS (SELECT kp_id, ch, avg(x) AS mean, stddev_pop(x) AS spread FROM s GROUP BY ALL),
d AS (SELECT s.kp_id, list((x - mean) / CASE WHEN spread > 0 THEN spread ELSE 1 END ORDER BY node, s.ch) AS y FROM s JOIN m ON m.kp_id = s.kp_id AND m.ch = s.ch GROUP BY 1) SELECT kp_id, {_sql_text('y')} AS descriptor FROM d""",
    "gradient_field_sample": f"WITH {ctes('v_patch')}, p AS (SELECT kp_id, data, {_AT} FROM v_patch), s AS (SELECT kp_id, [{_gradient_field()}] AS d FROM p) SELECT kp_id, {_sql_text('d')} AS descriptor FROM s",
    "scored_matches": f"""WITH once AS (SELECT DISTINCT ON (pair_ord) pair_ord, pair_id, coalesce(stored_reversed, false) AS back, matches0 FROM pair_matches),
raw AS (SELECT pair_id, back, unnest(range(len(matches0))) AS i, unnest(matches0) AS m FROM once),
d AS (SELECT pair_id, CAST(i AS INTEGER) AS match_ord, pair_id // 2147483647 AS image1, CAST(CASE WHEN back THEN m ELSE i END AS INTEGER) AS kp1, pair_id % 2147483647 AS image2, CAST(CASE WHEN back THEN i ELSE m END AS INTEGER) AS kp2 FROM raw WHERE m >= 0),
b AS (SELECT DISTINCT ON (image_id) image_id, rows, hex(data) AS h FROM descriptors WHERE cols = 128 AND octet_length(data) = CAST(rows AS BIGINT) * 128 AND image_id IS NOT NULL),
j AS (SELECT d.*, list_transform(range(128), lambda k: {_BYTE.format(h="x.h", kp="d.kp1")}) AS a, list_transform(range(128), lambda k: {_BYTE.format(h="y.h", kp="d.kp2")}) AS b FROM d LEFT JOIN b x ON x.image_id = d.image1 AND d.kp1 < x.rows LEFT JOIN b y ON y.image_id = d.image2 AND d.kp2 < y.rows),
s AS (SELECT *, list_sum(list_transform(a, lambda v: v * v))::DOUBLE * list_sum(list_transform(b, lambda v: v * v))::DOUBLE AS size, list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2]))::DOUBLE AS dot FROM j)
SELECT pair_id, match_ord, image1, kp1, image2, kp2, CASE WHEN size > 0 THEN round(dot / sqrt(size), 6) ELSE 1.0::DOUBLE END AS score FROM s""",
    "patch_slice": f"""WITH {ctes("v_patch")}, p AS (SELECT *, {_AT} FROM v_patch), q AS (SELECT *, CAST(least(greatest(trunc(round(u - 1, 9)), 0), 2) AS INTEGER) AS dc, CAST(least(greatest(trunc(round(v - 1, 9)), 0), 2) AS INTEGER) AS dr FROM p)
SELECT kp_id, x0 + dc AS x0, y0 + dr AS y0, 2 AS h, 2 AS w, {_sql_text("list_transform(list_concat(data[dr * 16 + dc * 4 + 1 : dr * 16 + dc * 4 + 8], data[dr * 16 + dc * 4 + 17 : dr * 16 + dc * 4 + 24]), lambda z: CAST(z AS DOUBLE))")} AS data FROM q""",
    "robust_costs": f"""WITH {ctes("v_desc")}, f AS (SELECT track, arg_min(embedding, obs) AS reference FROM v_desc GROUP BY 1), s AS (SELECT d.track, obs, {_D2.format(a="embedding", b="reference")} AS s FROM v_desc d JOIN f ON f.track = d.track)
SELECT track, obs, round(s, 6) + 0.0 AS trivial, round({_CAUCHY.format(s="s")}, 6) + 0.0 AS cauchy, round(CASE WHEN s > 0.0625::DOUBLE THEN 0.5::DOUBLE * sqrt(s) - 0.0625::DOUBLE ELSE s END, 6) + 0.0 AS huber, round(0.125::DOUBLE * (sqrt(1 + s / 0.0625::DOUBLE) - 1), 6) + 0.0 AS soft_l1 FROM s""",
    "robust_mean_irls": f"WITH {ctes('v_desc')}, {_irls()} SELECT CAST(track AS BIGINT) AS point3d_id, {_sql_text('mean')} AS mean FROM m3",
    "reference_source": f"{_SOURCE} SELECT CAST(track AS BIGINT) AS point3d_id, image_id AS src_image_id, kp_id AS src_kp_id FROM src WHERE rank = 1",
    "reference_observations": f"""{_SOURCE}, best AS (SELECT track, embedding AS reference FROM src WHERE rank = 1), c AS (SELECT f.track, f.track_pos, f.kp_id, {_D2.format(a="f.embedding", b="b.reference")} AS s FROM far f JOIN best b ON b.track = f.track)
SELECT CAST(track AS BIGINT) AS point3d_id, CAST(track_pos AS INTEGER) AS track_pos, kp_id, round({_CAUCHY.format(s="s")} / 2, 6) + 0.0 AS cost FROM c""",
    "nearest_reference": f"""WITH {ctes("v_desc")}, q AS (SELECT *, (track + 1) % 10 AS other FROM v_desc),
r AS (SELECT CAST(q.image_id AS VARCHAR) AS query, q.kp_id AS pos, CAST(q.other AS BIGINT) AS point3d_id, d.kp_id AS src_kp_id, row_number() OVER (PARTITION BY q.kp_id ORDER BY {_D2.format(a="q.embedding", b="d.embedding")}, d.obs) AS rank FROM q JOIN v_desc d ON d.track = q.other)
SELECT query, pos, point3d_id, src_kp_id FROM r WHERE rank = 1""",
    "stored_references": """WITH p AS (SELECT DISTINCT ON (level, point3d_id) * FROM point_references WHERE len(costs) = len(track_list_image_id)),
o AS (SELECT level, point3d_id, unnest(range(len(costs))) AS pos, unnest(costs) AS cost, unnest(track_list_image_id) AS image_id, unnest(track_list_point2d_idx) AS kp_id FROM p)
SELECT level, point3d_id, image_id, kp_id FROM o WHERE cost IS NOT NULL AND NOT isnan(cost) AND image_id >= 0 AND kp_id >= 0 QUALIFY row_number() OVER (PARTITION BY level, point3d_id ORDER BY cost, pos) = 1""",
    "costmap_gradients": f"""WITH {ctes("v_patch")}, k AS (SELECT kp_id, data, k, k // 4 AS r, k % 4 AS c FROM v_patch, range(16) t(k)),
x AS (SELECT kp_id, k, ch, {_at('r', 'c')} - {_at('0', '0')} AS d, ({_at('least(r + 1, 3)', 'c')} - {_at('greatest(r - 1, 0)', 'c')}) / 2 AS by_r, ({_at('r', 'least(c + 1, 3)')} - {_at('r', 'greatest(c - 1, 0)')}) / 2 AS by_c FROM k, range(4) u(ch)),
s AS (SELECT kp_id, k, sum(d * d) AS s, sum(d * by_r) AS rr, sum(d * by_c) AS rc FROM x GROUP BY ALL),
g AS (SELECT kp_id, k, 0.03125::DOUBLE * ln(1 + s / 0.0625::DOUBLE) AS cost, rr / (1 + s / 0.0625::DOUBLE) AS dr, rc / (1 + s / 0.0625::DOUBLE) AS dc FROM s),
o AS (SELECT kp_id, list([cost, CASE WHEN cost > {costmaps.LEAST_COST}::DOUBLE THEN dr ELSE 0 END, CASE WHEN cost > {costmaps.LEAST_COST}::DOUBLE THEN dc ELSE 0 END] ORDER BY k) AS d FROM g GROUP BY 1)
SELECT kp_id, 4 AS h, 4 AS w, 3 AS c, {_sql_text('flatten(d)', 4)} AS data FROM o""",
    "costmap_cost": f"""WITH {ctes("v_patch")}, c AS (SELECT kp_id, list_transform(range(16), lambda k: 0.03125::DOUBLE * ln(1 + list_sum(list_transform(range(4), lambda j: (CAST(data[4 * k + j + 1] AS DOUBLE) - CAST(data[j + 1] AS DOUBLE)) ** 2)) / 0.0625::DOUBLE)) AS costs FROM v_patch)
SELECT kp_id, {_sql_text('costs')} AS costs FROM c""",
}
