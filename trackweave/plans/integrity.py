"""Reference checks of images, descriptors and pair matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trackweave.operators.integrity import orphan_rates, orphan_references, references_of, targets_of
from trackweave.runtime import table


def domain_references(spark: SparkSession, sf: str) -> DataFrame:
    return (
        references_of(table(spark, sf, "images"), "camera", "images", ["camera_id"], "image_id", "added_at")
        .unionByName(references_of(table(spark, sf, "descriptors"), "image", "descriptors", ["image_id"], "image_id", "loaded_at"))
        .unionByName(references_of(table(spark, sf, "pair_matches"), "image_name", "pair_matches", ["name1", "name2"], "pair_ord", "matched_at"))
    )


def domain_targets(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "images")
    return (
        targets_of(table(spark, sf, "cameras"), "camera", "camera_id")
        .unionByName(targets_of(images, "image", "image_id"))
        .unionByName(targets_of(images, "image_name", "name"))
    )


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(domain_references(spark, sf), domain_targets(spark, sf)).select("src_table", "src_column", "row_key", "reason").distinct()


def p4_orphan_rates(spark: SparkSession, sf: str) -> DataFrame:
    references = domain_references(spark, sf)
    return orphan_rates(references, orphan_references(references, domain_targets(spark, sf)))


QUERIES = {"p4_found": p4_found, "p4_orphan_rates": p4_orphan_rates}

_REFS = """
refs AS (
  SELECT 'images' AS src_table, 'camera_id' AS src_column, CAST(image_id AS BIGINT) AS row_key, 'c' AS rel, CAST(camera_id AS VARCHAR) AS k, added_at AS t FROM images
  UNION SELECT 'descriptors', 'image_id', CAST(image_id AS BIGINT), 'i', CAST(image_id AS VARCHAR), loaded_at FROM descriptors
  UNION SELECT 'pair_matches', 'name1', pair_ord, 'n', name1, matched_at FROM pair_matches
  UNION SELECT 'pair_matches', 'name2', pair_ord, 'n', name2, matched_at FROM pair_matches),
targets AS (
  SELECT 'c' AS rel, CAST(camera_id AS VARCHAR) AS k, added_at, deleted_at FROM cameras
  UNION SELECT 'i', CAST(image_id AS VARCHAR), added_at, deleted_at FROM images
  UNION SELECT 'n', name, added_at, deleted_at FROM images),
judged AS (
  SELECT r.src_table, r.src_column, r.row_key, r.k, r.t, count(g.k) AS known,
         coalesce(bool_or(g.added_at <= r.t AND (g.deleted_at IS NULL OR g.deleted_at > r.t)), false) AS good,
         coalesce(bool_and(coalesce(g.added_at > r.t, false)), false) AS all_later
  FROM refs r LEFT JOIN targets g ON g.rel = r.rel AND g.k = r.k WHERE r.k IS NOT NULL GROUP BY ALL),
reasons AS (
  SELECT *, CASE WHEN good THEN NULL WHEN known = 0 THEN 'missing' WHEN all_later THEN 'late' ELSE 'deleted' END AS reason FROM judged)
"""

ORACLE = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT src_table, src_column, row_key, reason FROM reasons WHERE reason IS NOT NULL",
    "p4_orphan_rates": f"""WITH {_REFS}
SELECT src_table, src_column, strftime(t, '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (reason = 'missing') AS n_missing,
       count(*) FILTER (reason = 'deleted') AS n_deleted, count(*) FILTER (reason = 'late') AS n_late FROM reasons GROUP BY 1, 2, 3""",
}
