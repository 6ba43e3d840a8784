"""Queries of the training-data operators over the whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm import content, cooccurrence, grouping, mixing, neighbours, packing, percentiles, tokens
from trackweave.runtime import Scratch, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return grouping.keypoint_groups(table(spark, sf, "pair_matches"), table(spark, sf, "point_references"), Scratch(spark, "groups"))


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "percentiles")
    scores = percentiles.exact_percentiles([percentiles.kept_scores(table(spark, sf, "pair_matches"))], ["matcher", "day"], "score", scratch)
    costs = percentiles.exact_percentiles([percentiles.point_costs(table(spark, sf, "point_references"))], ["level", "scene"], "cost", scratch)
    return percentiles.labelled("matching_scores0", scores, F.col("matcher"), F.col("day")).unionByName(percentiles.labelled("costs", costs, F.col("level"), F.col("scene")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence.together(cooccurrence.basket_items(table(spark, sf, "point_references")), scratch=Scratch(spark, "together"))
    return pairs.select("scene", F.col("item1").cast("int").alias("image_id1"), F.col("item2").cast("int").alias("image_id2"))


def p3_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of images seen together at least four times, with how many times more often than chance."""
    return cooccurrence.together(cooccurrence.basket_items(table(spark, sf, "point_references")), least_lift=0.0)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "neighbours")
    fields = [
        ("point_references.descriptor", neighbours.Arrays(table(spark, sf, "point_references")), 0.90),
        ("descriptors.data", neighbours.Blobs(table(spark, sf, "descriptors")), 0.95),
    ]
    found = [neighbours.similar_pairs(vectors, least, neighbours.MOST_DIFFERENT[least], scratch, most_missed=neighbours.MOST_MISSED.get(least)).select(F.lit(name).alias("field"), "id1", "idx1", "id2", "idx2") for name, vectors, least in fields]
    return found[0].unionByName(found[1])


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 3 most similar others of every vector whose id is divisible by 50."""
    scratch, asked = Scratch(spark, "search"), F.col("id") % 50 == 0
    fields = [("point_references.descriptor", neighbours.Arrays(table(spark, sf, "point_references"))), ("descriptors.data", neighbours.Blobs(table(spark, sf, "descriptors")))]
    found = [neighbours.search(vectors, asked, scratch).withColumn("field", F.lit(name)) for name, vectors in fields]
    return found[0].unionByName(found[1])


def _sizes(spark: SparkSession, sf: str, scratch: Scratch) -> DataFrame:
    return scratch.save(tokens.with_tokens(table(spark, sf, "documents").select("doc_id", "source", "text")))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "packing")
    return packing.pack(_sizes(spark, sf, scratch), scratch)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf))


def p6_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What every packing must keep: documents, containers over capacity, documents whose pieces don't follow each other, and whole ones in several containers."""
    packed = p6_containers(spark, sf)
    over = packed.groupBy("stream", "container").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > packing.CAPACITY).alias("over_full"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("reached"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"))
    broken = (F.col("tokens") != F.col("reached")) | (F.col("pieces") != F.col("last") + 1)
    needless = (F.col("pieces") > 1) & (F.col("tokens") <= packing.CAPACITY)
    return whole.agg(F.count(F.lit(1)).alias("documents"), F.count_if(broken).alias("broken"), F.count_if(needless).alias("split_needlessly")).join(over)  # one row each


def p7_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What every mixture must keep: targets, documents repeated too often or without target, and sources farther from their budget than their largest document."""
    scratch = Scratch(spark, "mixing")
    sizes, targets = _sizes(spark, sf, scratch), table(spark, sf, "mix_targets")
    plan = mixing.budgets(sizes.where(F.col("source").isNotNull() & (F.col("n_tokens") > 0)), targets, None)
    chosen = scratch.save(mixing.mixture(sizes, targets, scratch))
    wrong = chosen.join(F.broadcast(plan.select("source", "max_repeats")), "source", "left").agg(F.count_if(F.coalesce(F.col("repeats") > F.col("max_repeats"), F.lit(True))).alias("repeated_too_often"))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    report = mixing.shares_report(chosen, plan).join(largest, "source", "left")
    return report.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.abs(F.col("tokens") - F.col("budget")) > F.coalesce("largest", F.lit(0))).alias("off_budget")).join(wrong)  # one row each


def p2_by_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The percentiles of scores per matcher, from the even and the odd days of matched_at as separate parts whose counts are combined."""
    pairs, odd = table(spark, sf, "pair_matches"), F.coalesce(F.dayofmonth("matched_at") % 2 == 1, F.lit(False))
    parts = [percentiles.kept_scores(pairs.where(odd)), percentiles.kept_scores(pairs.where(~odd))]
    found = percentiles.exact_percentiles(parts, ["matcher"], "score", Scratch(spark, "percentiles"))
    return found.select("matcher", "n", "percent", "value")


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    return mixing.mixture(_sizes(spark, sf, scratch), table(spark, sf, "mix_targets"), scratch)


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture of as many tokens as the documents have, with the share that each source reaches."""
    scratch = Scratch(spark, "mixing")
    sizes, targets = _sizes(spark, sf, scratch), table(spark, sf, "mix_targets")
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.shares_report(mixing.mixture(sizes, targets, scratch, total), mixing.budgets(sizes, targets, total))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_scores(spark, sf).where(F.col("probability") >= content.THRESHOLD).select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    return content.scored(table(spark, sf, "documents"), table(spark, sf, "doc_labels"), Scratch(spark, "content"))


def p8_rates(spark: SparkSession, sf: str) -> DataFrame:
    return content.rates(p8_scores(spark, sf))


QUERIES = {"p1_found": p1_found, "p2_percentiles": p2_percentiles, "p2_by_parts": p2_by_parts, "p3_found": p3_found, "p3_lift": p3_lift, "p5_found": p5_found, "p5_search": p5_search, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_invariants": p6_invariants, "p7_mixture": p7_mixture, "p7_invariants": p7_invariants, "p7_shares": p7_shares, "p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}

_P1 = """
WITH RECURSIVE m AS (
  SELECT pair_id % 2147483647 AS id2, pair_id // 2147483647 AS id1, coalesce(stored_reversed, false) AS rev, matches0 FROM pair_matches WHERE pair_id IS NOT NULL),
e AS (
  SELECT CASE WHEN rev THEN id2 ELSE id1 END AS f, CASE WHEN rev THEN id1 ELSE id2 END AS t, generate_subscripts(matches0, 1) - 1 AS k1, unnest(matches0) AS k2 FROM m),
o AS (SELECT point3d_id, unnest(track_list_image_id) AS i, unnest(track_list_point2d_idx) AS k FROM point_references),
links AS (
  SELECT f * 2147483648 + k1 AS a, t * 2147483648 + k2 AS b FROM e WHERE k2 >= 0
  UNION SELECT CAST(i AS BIGINT) * 2147483648 + k, min(CAST(i AS BIGINT) * 2147483648 + k) OVER (PARTITION BY point3d_id) FROM o WHERE i >= 0 AND k >= 0),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach(node, label) USING KEY (node) AS (
  SELECT a, least(a, min(b)) FROM both_ways GROUP BY a
  UNION SELECT w.a, min(r.label) FROM reach r JOIN both_ways w ON w.b = r.node JOIN recurring.reach c ON c.node = w.a WHERE r.label < c.label GROUP BY w.a)
SELECT CAST(node // 2147483648 AS INTEGER) AS image_id, CAST(node % 2147483648 AS INTEGER) AS kp_id,
       CAST(label // 2147483648 AS INTEGER) AS group_image_id, CAST(label % 2147483648 AS INTEGER) AS group_kp_id FROM reach"""

_P2 = """
WITH m AS (SELECT DISTINCT ON (pair_ord) pair_ord, matcher, CAST(matched_at AS DATE) AS d, matches0, matching_scores0 FROM pair_matches WHERE len(list_filter(matches0, lambda x: x >= 0)) > 0),
x AS (SELECT matcher, d, unnest(matches0) AS k, unnest(matching_scores0) AS s FROM m),
p AS (SELECT DISTINCT ON (level, point3d_id) level, point3d_id, scene, costs FROM point_references),
v AS (
  SELECT 'matching_scores0' AS field, matcher AS group1, CAST(d AS VARCHAR) AS group2, CAST(s AS DOUBLE) AS x FROM x WHERE k >= 0
  UNION ALL SELECT 'costs', CAST(level AS VARCHAR), scene, unnest(costs) FROM p),
r AS (
  SELECT *, count(*) OVER (PARTITION BY field, group1, group2) AS n, row_number() OVER (PARTITION BY field, group1, group2 ORDER BY x) AS rank
  FROM v WHERE x IS NOT NULL AND isfinite(x)),
q AS (SELECT unnest([1, 5, 50, 95, 99]) AS percent)
SELECT field, group1, group2, n, percent, x + 0.0 AS value, CAST(0 AS DOUBLE) AS error FROM r, q WHERE rank = greatest(1, (n * percent + 99) // 100)"""

_P3 = """
WITH o AS (SELECT scene, point3d_id, unnest(track_list_image_id) AS i, unnest(track_list_point2d_idx) AS k FROM point_references WHERE point3d_id IS NOT NULL),
b AS (SELECT DISTINCT scene, point3d_id, i FROM o WHERE i >= 0 AND k >= 0),
n AS (SELECT scene, count(DISTINCT point3d_id) AS n FROM b GROUP BY scene),
s AS (SELECT scene, i, count(*) AS c FROM b GROUP BY ALL),
g AS (SELECT x.scene, x.i AS i, y.i AS j, count(*) AS c FROM b x JOIN b y ON x.scene IS NOT DISTINCT FROM y.scene AND x.point3d_id = y.point3d_id AND x.i < y.i GROUP BY ALL),
f AS (
  SELECT g.scene, g.i, g.j, n.n, s1.c AS c1, s2.c AS c2, g.c FROM g JOIN n ON n.scene IS NOT DISTINCT FROM g.scene
  JOIN s s1 ON s1.scene IS NOT DISTINCT FROM g.scene AND s1.i = g.i JOIN s s2 ON s2.scene IS NOT DISTINCT FROM g.scene AND s2.i = g.j WHERE g.c >= 4)
"""

_P2_PARTS = """
WITH m AS (SELECT DISTINCT ON (pair_ord) pair_ord, matcher, matches0, matching_scores0 FROM pair_matches WHERE len(list_filter(matches0, lambda x: x >= 0)) > 0),
x AS (SELECT matcher, unnest(matches0) AS k, unnest(matching_scores0) AS s FROM m),
r AS (SELECT matcher, CAST(s AS DOUBLE) AS x, count(*) OVER (PARTITION BY matcher) AS n, row_number() OVER (PARTITION BY matcher ORDER BY s) AS rank FROM x WHERE k >= 0 AND s IS NOT NULL AND isfinite(s)),
q AS (SELECT unnest([1, 5, 50, 95, 99]) AS percent)
SELECT matcher, n, percent, x + 0.0 AS value FROM r, q WHERE rank = greatest(1, (n * percent + 99) // 100)"""

ORACLE = {
    "p1_found": _P1,
    "p2_percentiles": _P2,
    "p2_by_parts": _P2_PARTS,
    "p6_invariants": "SELECT count(*) AS documents, 0 AS broken, 0 AS split_needlessly, 0 AS over_full FROM documents",
    "p7_invariants": "SELECT count(DISTINCT source) AS targets, 0 AS off_budget, 0 AS repeated_too_often FROM mix_targets",
    "p3_found": f"{_P3} SELECT scene, i AS image_id1, j AS image_id2 FROM f WHERE c * n >= 3 * c1 * c2",
    "p3_lift": f"{_P3} SELECT scene, CAST(i AS BIGINT) AS item1, CAST(j AS BIGINT) AS item2, n, c1, c2, c, CAST(c * n AS DOUBLE) / (c1 * c2) AS lift FROM f",
}
