"""Queries of the corpus operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from . import chat, filter_audit, importance, language_id, line_dedup, near_dedup, packing, piece_codec, quality, quality_classifier, substring_dedup, topk_search, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_piece_codec": piece_codec.query,
    "op3_best_fit_packing": packing.query,
    "op4_line_dedup": line_dedup.query,
    "op5_exact_topk": topk_search.query,
    "op6_chat_format": chat.query,
    "op7_quality_rules": quality.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_language_id": language_id.query,
    "op10_toxicity": toxicity.query,
    "op11_filter_audit": filter_audit.query,
    "op12_quality_classifier": quality_classifier.query,
    "op13_importance_resampling": importance.query,
}

_WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRING_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM p WHERE i + 12 <= len(w)),
lo AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
hit AS (SELECT win.doc_id, i FROM win JOIN lo USING (s) WHERE lo.lo < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(generate_series(0, 12)) AS i FROM hit),
kept AS (SELECT p.doc_id, count(gone.i) AS n_removed, string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (WHERE gone.i IS NULL) AS t
         FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
        ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT d.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
FROM d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLE = {
    "op1_substring_dedup": SUBSTRING_SQL,
    "op5_exact_topk": topk_search.SQL,
    "op6_chat_format": chat.SQL,
    "op8_minhash_near_dedup": NEAR_SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op13_importance_resampling": importance.SQL,
}
