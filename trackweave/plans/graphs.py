"""Queries on match graphs, feature views and image pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import ids
from trackweave.operators import evaluation, graph, views
from trackweave.plans.views import ctes, view
from trackweave.runtime import Scratch, table
from trackweave.sources import tables

def _matches(spark: SparkSession, sf: str) -> DataFrame:
    once = table(spark, sf, "pair_matches").select("pair_ord", "pair_id", "stored_reversed", "matches0", "matching_scores0").dropDuplicates(["pair_ord"])
    return tables.decode_pair_matches(once)


def _graph_a(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(spark, "graph")
    nodes, edges = graph.build_matching_graph(scratch.save(_matches(spark, sf)))
    return scratch.save(nodes), edges


def _tracks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, Scratch]:
    """The match graph of pair_matches with its tracks."""
    scratch = Scratch(spark, "tracks")
    nodes, edges = _graph_a(spark, sf)
    edges = scratch.save(edges)
    return nodes, edges, scratch.save(graph.track_labels(nodes, edges, scratch)), scratch


def _components(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The match graph with its connected components in the place of tracks."""
    scratch = Scratch(spark, "components")
    nodes, edges = _graph_a(spark, sf)
    edges = scratch.save(edges)
    return nodes, edges, scratch.save(graph.components(nodes, edges, scratch).withColumnRenamed("component", "track"))


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def match_decode(spark, sf):
    """Every decoded match; a score that is NULL, NaN, infinite or beyond 1e6 is none."""
    return _rounded(_matches(spark, sf).withColumn("score", F.when(F.abs("score") < 1e6, F.col("score"))), "score")


def pair_id_roundtrip(spark, sf):
    first, second = ids.pair_images(F.col("pair_id"))
    pairs = table(spark, sf, "pair_matches").select("pair_id").distinct().select("pair_id", first.alias("id1"), second.alias("id2"))
    return pairs.withColumn("again", ids.pair_id(F.col("id2"), F.col("id1")))


def graph_nodes(spark, sf):
    return _graph_a(spark, sf)[0]


def graph_degrees(spark, sf):
    return graph.degrees(*_graph_a(spark, sf))


def graph_scores(spark, sf):
    nodes, edges = _graph_a(spark, sf)
    return _rounded(graph.scores(nodes, edges), "score", digits=4)


def required_patches(spark, sf):
    return graph.required_patches(_graph_a(spark, sf)[0]).select("image_id", F.array_join("kp_ids", " ").alias("kp_ids"))


def graph_components(spark, sf):
    return _components(spark, sf)[2].withColumnRenamed("track", "component")


def component_scores(spark, sf):
    nodes, edges, labels = _components(spark, sf)
    return _rounded(graph.score_labels(nodes, edges, labels), "score", digits=4)


def component_roots(spark, sf):
    nodes, edges, labels = _components(spark, sf)
    return graph.root_labels(labels, _rounded(graph.score_labels(nodes, edges, labels), "score", digits=4))


def component_edges_ab(spark, sf):
    nodes, edges, labels = _components(spark, sf)
    roots = graph.root_labels(labels, _rounded(graph.score_labels(nodes, edges, labels), "score", digits=4))
    return graph.count_edges_ab(edges, labels, roots).join(graph.count_track_edges(edges, labels), "track")


def track_labels(spark, sf):
    return _tracks(spark, sf)[2]


def track_roots(spark, sf):
    """The root observation and its score of every track."""
    nodes, edges, labels, _ = _tracks(spark, sf)
    scores = graph.score_labels(nodes, edges, labels)
    return labels.join(graph.root_labels(labels, scores).where("is_root"), "node_idx").join(scores, "node_idx").select("track", "node_idx", "score")


def track_root_edges(spark, sf):
    nodes, edges, labels, _ = _tracks(spark, sf)
    return graph.root_edges(edges, labels, graph.root_labels(labels, graph.score_labels(nodes, edges, labels)))


def problem_labels_ba(spark, sf):
    return graph.ba_problem_labels(view(spark, sf, "v_points3d"), 50)


def problem_labels_ka(spark, sf):
    return graph.ka_problem_labels(_tracks(spark, sf)[2], 50)


def track_invariants(spark, sf):
    """What every track labelling must keep: nodes, edges, images that stand twice in a track, and edges between tracks that could still merge."""
    nodes, edges, labels, _ = _tracks(spark, sf)
    members = labels.join(nodes, "node_idx")
    sets = members.groupBy("track").agg(F.collect_set("image_id").alias("images"), F.count(F.lit(1)).alias("size"))
    side = lambda end: labels.select(F.col("node_idx").alias(end), F.col("track").alias(f"track_{end}")).join(sets.select(F.col("track").alias(f"track_{end}"), F.col("images").alias(f"images_{end}")), f"track_{end}")
    ends = edges.where("src <> dst").join(side("src"), "src").join(side("dst"), "dst")
    open_edges = ends.agg(F.count(F.lit(1)).alias("edges"), F.count_if((F.col("track_src") != F.col("track_dst")) & ~F.arrays_overlap("images_src", "images_dst")).alias("mergeable"))
    return sets.agg(F.sum("size").alias("nodes"), F.sum(F.col("size") - F.size("images")).alias("images_twice")).join(open_edges)  # one row each


def problem_invariants(spark, sf):
    """What every packing of tracks into problems must keep: nodes, tracks that are split, and problems of several tracks with more nodes than 50."""
    labels = _tracks(spark, sf)[2]
    packed = labels.join(graph.ka_problem_labels(labels, 50), "node_idx")
    split = packed.groupBy("track").agg(F.countDistinct("problem").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_tracks"))
    full = packed.groupBy("problem").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("track").alias("tracks")).agg(F.count_if((F.col("size") > 50) & (F.col("tracks") > 1)).alias("over_full"), F.sum("size").alias("nodes"))
    return split.join(full)  # one row each


def _track_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Observations (point3d_id, image_id, kp_id) of the reference tables, each once."""
    rows = table(spark, sf, "point_references").select("point3d_id", F.explode(F.arrays_zip("track_list_image_id", "track_list_point2d_idx")).alias("o"))
    return rows.select("point3d_id", F.col("o.track_list_image_id").alias("image_id"), F.col("o.track_list_point2d_idx").alias("kp_id")).where("image_id >= 0 AND kp_id >= 0").distinct()


def track_lengths(spark, sf):
    return views.track_lengths(_track_rows(spark, sf))


def long_tracks(spark, sf):
    return views.long_tracks(_track_rows(spark, sf), 4)


def contained_tracks(spark, sf):
    registered = table(spark, sf, "images").where("registered").select("image_id")
    return views.contained_tracks(_track_rows(spark, sf), registered)


def images_with_points(spark, sf):
    return views.images_with_points(table(spark, sf, "images").select("image_id", "name").distinct(), _track_rows(spark, sf))


def residuals_per_image(spark, sf):
    return views.residual_counts(_track_rows(spark, sf), "image_id")


def feature_view(spark, sf):
    required = table(spark, sf, "lineitem").select(F.concat(F.lit("image"), (F.col("l_suppkey") % 20).cast("string")).alias("image_name"), F.col("l_partkey").cast("int").alias("kp_id"))
    return views.feature_view(view(spark, sf, "v_patch"), required).select("image_name", "kp_id", "x0", "y0")


def memory_by_level(spark, sf):
    from trackweave.operators.sampling import memory_by_level as measure

    return measure(view(spark, sf, "v_patch"))


def exhaustive_pairs(spark, sf):
    return views.exhaustive_pairs(view(spark, sf, "v_images"))


def holdout_pairs(spark, sf):
    images = view(spark, sf, "v_images")
    return views.holdout_pairs(images, images.where("camera_id < 5"))


def query_pairs(spark, sf):
    images = view(spark, sf, "v_images")
    queries = images.where("camera_id = 3").select(F.col("name").alias("query"))
    return views.pairs_of_queries(images, queries, images.where("camera_id = 7"))


def query_points(spark, sf):
    matches = _matches(spark, sf).select(F.col("image2").cast("string").alias("query"), F.col("kp2").alias("kp_id"), F.col("image1").cast("int").alias("image_id"), F.col("kp1").alias("db_kp_id"))
    return views.query_points(matches, _track_rows(spark, sf))


def covisible_pairs(spark, sf):
    return evaluation.covisible_pairs(_track_rows(spark, sf))


def covisibility_holdout(spark, sf):
    return evaluation.covisibility_holdout(_track_rows(spark, sf), 5)


QUERIES = {f.__name__: f for f in (
    match_decode, pair_id_roundtrip, graph_nodes, graph_degrees, graph_scores, required_patches, graph_components, component_scores, component_roots, component_edges_ab, track_labels, track_roots, track_root_edges,
    track_invariants, problem_invariants, problem_labels_ba, problem_labels_ka, track_lengths, long_tracks, contained_tracks, images_with_points, residuals_per_image, feature_view, memory_by_level, exhaustive_pairs, holdout_pairs, query_pairs, query_points, covisible_pairs, covisibility_holdout,
)}

_DECODED = """
once AS (SELECT DISTINCT ON (pair_ord) pair_ord, pair_id, coalesce(stored_reversed, false) AS back, matches0, matching_scores0 FROM pair_matches),
raw AS (SELECT pair_ord, pair_id // 2147483647 AS image1, pair_id % 2147483647 AS image2, back, unnest(range(len(matches0))) AS i, matches0, matching_scores0 FROM once),
picked AS (SELECT *, matches0[i + 1] AS m, CAST(matching_scores0[i + 1] AS DOUBLE) AS score FROM raw),
d AS (SELECT pair_ord, CAST(i AS INTEGER) AS match_ord, image1, CAST(CASE WHEN back THEN m ELSE i END AS INTEGER) AS kp1, image2, CAST(CASE WHEN back THEN i ELSE m END AS INTEGER) AS kp2, score FROM picked WHERE m >= 0)"""
_NODES = f"""{_DECODED},
ends AS (SELECT pair_ord, match_ord, 0 AS e, image1 AS image_id, kp1 AS feature_idx FROM d UNION ALL SELECT pair_ord, match_ord, 1, image2, kp2 FROM d),
firsts AS (SELECT image_id, feature_idx, min((pair_ord, match_ord, e)) AS place FROM ends GROUP BY ALL),
nodes AS (SELECT row_number() OVER (ORDER BY place) - 1 AS node_idx, image_id, feature_idx FROM firsts),
edges AS (SELECT a.node_idx AS src, b.node_idx AS dst, CASE WHEN isnan(d.score) OR isinf(d.score) THEN 0 ELSE coalesce(d.score, 1.0) END AS sim FROM d JOIN nodes a ON a.image_id = d.image1 AND a.feature_idx = d.kp1 JOIN nodes b ON b.image_id = d.image2 AND b.feature_idx = d.kp2),
sides AS (SELECT src AS n, sim FROM edges UNION ALL SELECT dst, sim FROM edges)"""
_B = f"""{_NODES},
both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(node, label) USING KEY (node) AS (
  SELECT n.node_idx, least(n.node_idx, coalesce(min(w.b), n.node_idx)) FROM nodes n LEFT JOIN both_ways w ON w.a = n.node_idx GROUP BY n.node_idx
  UNION SELECT w.a, min(r.label) FROM reach r JOIN both_ways w ON w.b = r.node JOIN recurring.reach c ON c.node = w.a WHERE r.label < c.label GROUP BY w.a),
lab AS (SELECT node AS node_idx, label AS track FROM reach),
intra AS (SELECT e.*, a.track FROM edges e JOIN lab a ON a.node_idx = e.src JOIN lab b ON b.node_idx = e.dst WHERE a.track = b.track),
inner_sides AS (SELECT src AS n, sim FROM intra UNION ALL SELECT dst, sim FROM intra),
score AS (SELECT l.node_idx, l.track, round(coalesce(sum(s.sim), 0.0), 4) + 0.0 AS score FROM lab l LEFT JOIN inner_sides s ON s.n = l.node_idx GROUP BY ALL),
root AS (SELECT node_idx, track, row_number() OVER (PARTITION BY track ORDER BY score DESC, node_idx DESC) = 1 AS is_root FROM score)"""
_TRACKS = """
o AS (SELECT point3d_id, unnest(track_list_image_id) AS image_id, unnest(track_list_point2d_idx) AS kp_id FROM point_references),
t AS (SELECT DISTINCT point3d_id, image_id, kp_id FROM o WHERE image_id >= 0 AND kp_id >= 0)"""
_SHARED = "s AS (SELECT DISTINCT point3d_id, image_id FROM t), pairs AS (SELECT a.image_id AS image1, b.image_id AS image2, count(*) AS shared FROM s a JOIN s b ON a.point3d_id = b.point3d_id AND a.image_id < b.image_id GROUP BY 1, 2)"
_ALL_PAIRS = "pairs AS (SELECT a.name AS name1, b.name AS name2 FROM v_images a JOIN v_images b ON a.name < b.name)"

ORACLE = {
    "match_decode": f"WITH {_DECODED} SELECT pair_ord, match_ord, image1, kp1, image2, kp2, CASE WHEN NOT isnan(score) AND abs(score) < 1e6 THEN round(score, 6) + 0.0 END AS score FROM d",
    "pair_id_roundtrip": "SELECT DISTINCT pair_id, pair_id // 2147483647 AS id1, pair_id % 2147483647 AS id2, pair_id AS again FROM pair_matches",
    "graph_nodes": f"WITH {_NODES} SELECT * FROM nodes",
    "graph_degrees": f"WITH {_NODES} SELECT node_idx, count(s.n) AS degree FROM nodes LEFT JOIN sides s ON s.n = node_idx GROUP BY 1",
    "graph_scores": f"WITH {_NODES} SELECT node_idx, round(coalesce(sum(s.sim), 0.0), 4) + 0.0 AS score FROM nodes LEFT JOIN sides s ON s.n = node_idx GROUP BY 1",
    "required_patches": f"WITH {_NODES} SELECT image_id, string_agg(CAST(feature_idx AS VARCHAR), ' ' ORDER BY feature_idx) AS kp_ids FROM nodes GROUP BY 1",
    "graph_components": f"WITH RECURSIVE {_B} SELECT node_idx, track AS component FROM lab",
    "component_scores": f"WITH RECURSIVE {_B} SELECT node_idx, score FROM score",
    "component_roots": f"WITH RECURSIVE {_B} SELECT node_idx, is_root FROM root",
    "component_edges_ab": f"""WITH RECURSIVE {_B} SELECT l.track, count(i.src) FILTER (a.is_root OR b.is_root) AS root_edges, count(i.src) FILTER (NOT (a.is_root OR b.is_root)) AS other_edges, count(i.src) AS edges
FROM (SELECT DISTINCT track FROM lab) l LEFT JOIN intra i ON i.track = l.track LEFT JOIN root a ON a.node_idx = i.src LEFT JOIN root b ON b.node_idx = i.dst GROUP BY 1""",
    "track_invariants": f"WITH {_NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges WHERE src <> dst) AS edges, 0 AS images_twice, 0 AS mergeable",
    "problem_invariants": f"WITH {_NODES} SELECT (SELECT count(*) FROM nodes) AS nodes, 0 AS split_tracks, 0 AS over_full",
    "problem_labels_ba": f"WITH {ctes('v_points3d')} SELECT point3d_id, point3d_id // 50 AS problem FROM v_points3d",
    "track_lengths": f"WITH {_TRACKS} SELECT point3d_id, count(*) AS track_length FROM t GROUP BY 1",
    "long_tracks": f"WITH {_TRACKS} SELECT point3d_id, image_id, kp_id FROM t WHERE point3d_id IN (SELECT point3d_id FROM t GROUP BY 1 HAVING count(*) >= 4)",
    "contained_tracks": f"WITH {_TRACKS} SELECT point3d_id, bool_and(image_id IN (SELECT image_id FROM images WHERE registered AND image_id IS NOT NULL)) AS contained FROM t GROUP BY 1",
    "images_with_points": f"WITH {_TRACKS} SELECT DISTINCT image_id, name FROM images WHERE image_id IN (SELECT image_id FROM t)",
    "residuals_per_image": f"WITH {_TRACKS} SELECT image_id, count(*) AS residuals FROM t GROUP BY 1",
    "feature_view": f"WITH {ctes('v_patch')} SELECT image_name, kp_id, x0, y0 FROM v_patch WHERE (image_name, kp_id) IN (SELECT 'image' || CAST(l_suppkey % 20 AS VARCHAR), CAST(l_partkey AS INTEGER) FROM lineitem)",
    "memory_by_level": f"WITH {ctes('v_patch')} SELECT level, count(*) AS patches, count(DISTINCT image_name) AS images, CAST(sum(CAST(h AS BIGINT) * w * c * 4) AS BIGINT) AS bytes FROM v_patch GROUP BY 1",
    "exhaustive_pairs": f"WITH {ctes('v_images')}, {_ALL_PAIRS} SELECT * FROM pairs",
    "holdout_pairs": f"WITH {ctes('v_images')}, {_ALL_PAIRS}, x AS (SELECT name FROM v_images WHERE camera_id < 5) SELECT * FROM pairs WHERE name1 NOT IN (SELECT name FROM x) AND name2 NOT IN (SELECT name FROM x)",
    "query_pairs": f"""WITH {ctes('v_images')}, {_ALL_PAIRS}, w AS (SELECT name1 AS query, name2 AS other FROM pairs UNION ALL SELECT name2, name1 FROM pairs)
SELECT query, other FROM w WHERE query IN (SELECT name FROM v_images WHERE camera_id = 3) AND other NOT IN (SELECT name FROM v_images WHERE camera_id = 7)""",
    "query_points": f"WITH {_DECODED}, {_TRACKS} SELECT DISTINCT CAST(d.image2 AS VARCHAR) AS query, d.kp2 AS kp_id, t.point3d_id FROM d JOIN t ON t.image_id = d.image1 AND t.kp_id = d.kp1",
    "covisible_pairs": f"WITH {_TRACKS}, {_SHARED} SELECT * FROM pairs",
    "covisibility_holdout": f"""WITH {_TRACKS}, {_SHARED}, w AS (SELECT image1 AS image_id, image2 AS excluded, shared FROM pairs UNION ALL SELECT image2, image1, shared FROM pairs)
SELECT image_id, excluded, shared FROM w QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, excluded) <= 5""",
}
