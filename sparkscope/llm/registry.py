"""Queries of the corpus operators over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import hardnegatives, langid, licenses, nndescent, packing, simhash, sitetree, tiling, tokencount, urls, warc, whitening, windows
from sparkscope.session import table


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitetree.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op5_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = langid.fit_language_model(docs)
    held = (langid.fold() == 1).alias("held_out")
    return langid.predict_languages(docs.select("doc_id", held, "text"), model).drop("text")


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(table(spark, sf_dir, "documents"))


def op10_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hardnegatives.mine_hard_negatives(table(spark, sf_dir, "embeddings"), label=label, anchor=F.col("vec_id") % 50 == 0)
    return found.drop("anchor_label")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_index(warc.write_archive(table(spark, sf_dir, "pages"))).drop("url")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_site_style_tree, op2_nn_descent, op3_string_tiling, op4_license_automaton, op5_trie_token_counts, op6_cost_balanced_packing,
        op7_simhash_vp_tree, op8_language_id, op9_compact_windows, op10_url_vocabulary, op11_hard_negatives, op12_warc_archive, op13_whitening, pipeline,
    )
}

#: The given pages keep their article in one element, so for them SQL can say what is left: its text without tags.
PAGES_SQL = r"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(a, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM article),
plain AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM bare)
SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text, CAST(length(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS BIGINT) AS n_chars FROM plain"""

#: All pairs by cosine, and what can be reached over them; quadratic, for small tables.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
groups AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN groups USING (vec_id) LEFT JOIN counts ON a = v.vec_id"""

#: All anchors against all rows; quadratic, for small tables.
NEGATIVES_SQL = """
WITH x AS (SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM x a JOIN x b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""

#: Base 32 as in RFC 4648: five hexadecimal digits are four of its digits.
_BASE32 = " || ".join(f"substr('{warc.BASE32}', CAST((part[{i}] >> {shift}) & 31 AS INTEGER) + 1, 1)" for i in range(1, 9) for shift in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, list_transform(range(8), lambda i: CAST('0x' || substr(sha1(payload), CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS part, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d"""

ORACLES: dict[str, str] = {"op1_site_style_tree": PAGES_SQL, "op2_nn_descent": VECTORS_SQL, "op10_url_vocabulary": urls.oracle(), "op11_hard_negatives": NEGATIVES_SQL, "op12_warc_archive": WARC_SQL}
