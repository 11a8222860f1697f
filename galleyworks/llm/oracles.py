"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from galleyworks.llm.mixing import BUDGET, LEVELS, MOST_REPEATS, WEIGHTS

#: Sorting in place of thresholds: documents by hash, running sums, the boundary document by nearness.
OP6 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, {sum(LEVELS) // 4}))::BIGINT AS h
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS weight
  FROM docs GROUP BY source
), total AS (SELECT sum(source_size) * {BUDGET}::DOUBLE AS budget FROM sources),
fill AS (
  SELECT 0 AS round, source, source_size, weight, NULL::DOUBLE AS fixed FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         CASE WHEN fixed IS NOT NULL THEN fixed
              WHEN ((SELECT budget FROM total) - coalesce(sum(fixed) OVER (), 0)) * weight / sum(CASE WHEN fixed IS NULL THEN weight END) OVER () >= {MOST_REPEATS} * source_size THEN {MOST_REPEATS}.0 * source_size END
  FROM fill WHERE round < 64
), final AS (
  SELECT source, source_size,
         coalesce(fixed, ((SELECT budget FROM total) - coalesce(sum(fixed) OVER (), 0)) * weight / sum(CASE WHEN fixed IS NULL THEN weight END) OVER ()) AS target
  FROM fill WHERE round = 64
), goals AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM final
), ranked AS (
  SELECT d.*, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       size * least(whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND (rest - (upto - own)) * 2 >= own)) THEN 1 ELSE 0 END, {MOST_REPEATS}) AS taken
FROM ranked
"""

OP12 = """
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM part a JOIN part b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

ORACLES = {"op6_source_mixing": OP6, "op12_hard_negatives": OP12}
