"""One query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import alignment, decontaminate, embedding_dedup, lexical_search, line_templates, near_dedup, packing, pii, quality, token_files, toxicity, url_reputation, vector_search
from strata.sources.readers import read_table


def op1_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, d, "documents"))


def op2_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, d, "documents"))


def op3_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_personal_data(read_table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.classify(read_table(spark, d, "documents"), read_table(spark, d, "labels"))


def op5_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = quality.sites_of_pages(read_table(spark, d, "documents"), read_table(spark, d, "pages"))
    return quality.rate_quality(docs, read_table(spark, d, "labels"))


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"))


def op7_decontamination(spark: SparkSession, d: str) -> DataFrame:
    leaks = decontaminate.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "question_percent", "answer_percent")


def op8_url_reputation(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select("page_id", "url")
    outcomes = url_reputation.outcomes_from_labels(pages, read_table(spark, d, "labels"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op9_line_templates(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return line_templates.drop_recurring_lines(docs.select("doc_id", "text"))


def op10_vector_search(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    return vector_search.nearest(rows, rows.filter("vec_id % 100 = 0"))


def op11_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical_search.search(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"))


def op12_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.linked_vectors(read_table(spark, d, "embeddings"))


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, d, "documents"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_dedup, op2_token_files, op3_personal_data, op4_toxicity, op5_quality,
        op6_packing, op7_decontamination, op8_url_reputation, op9_line_templates, op10_vector_search,
        op11_lexical_search, op12_embedding_dedup, op13_alignment,
    )
}

_URL_PARTS = """
raw AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
cut AS (SELECT page_id, rest, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM raw),
part AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path
  FROM cut
)"""

# The terms of a text, A-Z lower-cased.
_TERMS = r"""regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

LLM_ORACLE: dict[str, str] = {
    "op11_lexical_search": f"""
WITH doc AS (SELECT row_number() OVER () AS pos, doc_id, {_TERMS} AS t FROM documents),
size AS (SELECT pos, doc_id, CAST(len(t) AS BIGINT) AS n FROM doc),
total AS (SELECT count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS len FROM size),
held AS (SELECT pos, term, count(*) AS tf FROM (SELECT pos, unnest(t) AS term FROM doc) GROUP BY pos, term),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL))
  GROUP BY item_id, term
),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, total WHERE term IN (SELECT term FROM asked) GROUP BY term
),
damped AS (SELECT pos, doc_id, 25 + (75 * n * docs) // len AS m FROM size, total WHERE n > 0 AND doc_id IS NOT NULL),
scored AS (
  SELECT item_id, doc_id, pos, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN damped USING (pos) GROUP BY item_id, doc_id, pos
),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {lexical_search.K}
""",
    "op8_url_reputation": f"""
WITH {_URL_PARTS},
shown AS (
  SELECT DISTINCT page_id, CAST(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) AS BIGINT) AS doc_id
  FROM part WHERE regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) <> ''
),
good AS (SELECT doc_id, min(quality) AS good FROM labels GROUP BY doc_id),
outcome AS (SELECT page_id, min(good) AS good FROM shown JOIN good USING (doc_id) GROUP BY page_id),
counted AS (
  SELECT host, count(*) AS n, sum(good) AS good FROM part JOIN outcome USING (page_id) WHERE good IS NOT NULL GROUP BY host
),
labels AS (
  SELECT host, site, string_split(site, '.') AS l, coalesce(n, 0) AS n, coalesce(good, 0) AS good
  FROM (SELECT DISTINCT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM part) LEFT JOIN counted USING (host)
),
wide AS (SELECT *, CASE WHEN len(l) > 1 AND array_to_string(l[-2:], '.') IN ({", ".join(f"'{x}'" for x in url_reputation.TWO_LABELS)}) THEN 2 ELSE 1 END AS w FROM labels),
tree AS (
  SELECT host, n, good, CASE WHEN regexp_matches(site, '^[0-9.]+$') THEN site ELSE array_to_string(l[greatest(len(l) - w, 1):], '.') END AS domain,
         CASE WHEN regexp_matches(site, '^[0-9.]+$') THEN site ELSE array_to_string(l[greatest(len(l) - w + 1, 1):], '.') END AS suffix
  FROM wide
),
total AS (SELECT coalesce(sum(good) / nullif(sum(n), 0), 0.5) AS overall FROM tree),
members AS (
  SELECT 'h' AS lvl, sum(n) AS n, sum(good) AS good FROM tree WHERE n > 0 GROUP BY host
  UNION ALL SELECT 'd', sum(n), sum(good) FROM tree WHERE n > 0 GROUP BY domain
  UNION ALL SELECT 's', sum(n), sum(good) FROM tree WHERE n > 0 GROUP BY suffix
),
moments AS (
  SELECT lvl, (sum(good) / sum(n)) * (1 - sum(good) / sum(n)) AS noise,
         sum(n * (good / n - overall) * (good / n - overall)) / sum(n) AS spread, count(*) / sum(n) AS share
  FROM members, total GROUP BY lvl
),
strength AS (
  SELECT lvl, CASE WHEN spread > noise * share
    THEN least(greatest((noise - spread) / (spread - noise * share), {url_reputation.MIN_STRENGTH}), {url_reputation.MAX_STRENGTH})
    ELSE {url_reputation.MAX_STRENGTH} END AS k
  FROM moments
),
fixed AS (
  SELECT overall, coalesce((SELECT k FROM strength WHERE lvl = 's'), {url_reputation.MIN_STRENGTH}) AS ks,
         coalesce((SELECT k FROM strength WHERE lvl = 'd'), {url_reputation.MIN_STRENGTH}) AS kd,
         coalesce((SELECT k FROM strength WHERE lvl = 'h'), {url_reputation.MIN_STRENGTH}) AS kh FROM total
),
suffixes AS (SELECT suffix, (sum(good) + ks * overall) / (sum(n) + ks) AS ps FROM tree, fixed GROUP BY suffix, ks, overall),
domains AS (
  SELECT domain, suffix, (sum(good) + kd * ps) / (sum(n) + kd) AS pd
  FROM tree JOIN suffixes USING (suffix), fixed GROUP BY domain, suffix, kd, ps
),
hosts AS (
  SELECT host, (good + kh * pd) / (n + kh) AS mean, n + kh AS size FROM tree JOIN domains USING (domain, suffix), fixed
),
judged AS (
  SELECT page_id, host, path, mean - {url_reputation.Z} * sqrt(greatest(mean * (1 - mean), 0.0) / (size + 1)) AS bound,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM part JOIN hosts USING (host)
)
SELECT page_id, host, path, rule,
  CASE rule WHEN 'org/' THEN 'allow' WHEN 'com/fr/' THEN 'allow' WHEN 'example.org/es/' THEN 'block'
    WHEN 'example.org/en/1' THEN 'block' WHEN 'com/de/' THEN 'block'
    ELSE CASE WHEN bound >= {url_reputation.FLOOR} THEN 'allow' ELSE 'block' END END AS verdict
FROM judged
""",
}
