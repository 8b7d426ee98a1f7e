"""Queries of this subpackage: name -> (spark, folder) -> DataFrame, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from .decontam import op10_blockmax_wand
from .jaccard import op5_jaccard_rtree
from .langid import op3_byte_gru
from .lm_score import op1_lattice_lm
from .media import op9_wav_fingerprints
from .negatives import op11_pca_negatives
from .packing import op2_length_buckets
from .periodic import op12_kolpakov_kucherov
from .sharding import op4_differencing_shards
from .simhash import op13_bk_trees
from .token_counts import op8_edit_counts
from .token_output import op6_arrow_sequences
from .toxicity import op7_boosted_toxicity

QUERIES = {
    "op1_lattice_lm": op1_lattice_lm,
    "op2_length_buckets": op2_length_buckets,
    "op3_byte_gru": op3_byte_gru,
    "op4_differencing_shards": op4_differencing_shards,
    "op5_jaccard_rtree": op5_jaccard_rtree,
    "op6_arrow_sequences": op6_arrow_sequences,
    "op7_boosted_toxicity": op7_boosted_toxicity,
    "op8_edit_counts": op8_edit_counts,
    "op9_wav_fingerprints": op9_wav_fingerprints,
    "op10_blockmax_wand": op10_blockmax_wand,
    "op11_pca_negatives": op11_pca_negatives,
    "op12_kolpakov_kucherov": op12_kolpakov_kucherov,
    "op13_bk_trees": op13_bk_trees,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Components of near duplicates and hard negatives can be said in SQL; the other operators learn, search or write files.
SQL: dict[str, str] = {
    "op5_jaccard_rtree": rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS t
 FROM documents),
 s AS (SELECT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE
 list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], ' '))) END) AS g FROM w),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT i, j FROM p JOIN n x ON x.doc_id = i JOIN n y ON y.doc_id = j WHERE 100 * k >= 80 * (x.n + y.n - k)),
 e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
 r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.i, r.root FROM r JOIN e ON e.j = r.id)
 SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY
 r.id""",
    "op11_pca_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same,
    CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id
  WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score
  FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
WHERE 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
""",
}
