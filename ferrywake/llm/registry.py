"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import cover_tree, decontaminate, html_text, language, lattice, pii, sharding, simhash, suffix_dedup, training_order

QUERIES = {
    "op1_crf_language": language.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_pii_spans": pii.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_histogram_sharding": sharding.op5,
    "op6_html_main_text": html_text.op6,
    "op7_cover_tree_near_dedup": cover_tree.op7,
    "op8_training_order": training_order.op8,
    "op9_gumbel_segmentations": lattice.op9,
    "pipeline": corpus_pipeline.run,
    "op10_string_tiling_decontamination": decontaminate.op10,
}
#: Exact pairs and their components, for tables of a size that SQL can join with themselves. The other operators rest on
#: hashes, models, trees, sequential marking or look-around that DuckDB has not; tests hold them against plain Python.
SQL: dict[str, str] = {
    "op7_cover_tree_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
  r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
  n AS (SELECT a, COUNT(*) AS c FROM l GROUP BY 1)
SELECT v.vec_id, COALESCE(n.c, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN (SELECT a, MIN(b) AS component_id FROM r GROUP BY 1) m ON m.a = v.vec_id
""",
}
