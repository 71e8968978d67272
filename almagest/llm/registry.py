"""Queries of the training-data operators, and SQL where it can express them."""

from almagest.llm.byte_bpe import op3_byte_bpe
from almagest.llm.context_mixing import op6_context_mixing
from almagest.llm.media import op9_media
from almagest.llm.mixing import op4_source_mixing
from almagest.llm.ngram_join import op2_ngram_jaccard_join
from almagest.llm.order_minhash import op5_order_minhash
from almagest.llm.quality import op8_quality
from almagest.llm.substring_dedup import op1_substring_dedup
from almagest.llm.token_files import op7_token_files
from almagest.llm.toxicity import op10_toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_source_mixing": op4_source_mixing,
    "op5_order_minhash": op5_order_minhash,
    "op6_context_mixing": op6_context_mixing,
    "op7_token_files": op7_token_files,
    "op8_quality": op8_quality,
    "op9_media": op9_media,
    "op10_toxicity": op10_toxicity,
    "pipeline": pipeline,
}

#: Words of each document by position.
_WORDS = r"""w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents)"""

ORACLE_SQL = {
    "op1_substring_dedup": f"""
WITH {_WORDS},
win AS (SELECT doc_id, p, ws[p:p + 12] AS g FROM w, unnest(generate_series(1, len(ws) - 12)) u(p)),
least AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT win.doc_id, p FROM win JOIN least USING (g) WHERE m < win.doc_id),
gone AS (SELECT DISTINCT doc_id, p + k AS q FROM hit, generate_series(0, 12) s(k)),
cut AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)""",
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, ws[p:p + 2] AS s FROM w, unnest(generate_series(1, greatest(len(ws) - 2, 1))) u(p) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT a AS d, b AS r FROM link UNION SELECT reach.d, link.b FROM reach JOIN link ON reach.r = link.a),
least AS (SELECT d, least(min(r), d) AS c FROM reach GROUP BY d),
degree AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, coalesce(least.c, w.doc_id) AS component_id, CAST(coalesce(degree.k, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN least ON least.d = w.doc_id LEFT JOIN degree ON degree.a = w.doc_id""",
}
