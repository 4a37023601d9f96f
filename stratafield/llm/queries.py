"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, fingerprints, media, ngram_join, packing, personal_data, quality, secrets, token_files, url_filter

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
WORD_VOCABULARY = 49_408
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_table(spark, sf_dir, "documents"), WORD_BPE, WORD_VOCABULARY)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_digests(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


#: The policy that op10 applies (fixed values).
RULES = [url_filter.Rule(v, t) for v, t in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = url_filter.page_outcomes(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return url_filter.judge_pages(outcomes, RULES).drop("bad_rate")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data_digests(_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


_LEVEL = """{name} AS (SELECT {keys}, prior * strength + bad AS a, (1 - prior) * strength + n - bad AS b FROM {rows}, (SELECT coalesce(
    least(greatest(1 / greatest((sum(n * pow(bad / n - prior, 2)) - sum(prior * (1 - prior))) / greatest(sum((n - 1) * prior * (1 - prior)), 1e-9), 1e-3) - 1, 2.0), 1000.0), 2.0) AS strength FROM {rows} WHERE n > 0))"""


#: Kind of a text as ``url_filter.with_kind`` tells it.
_KIND = """CASE WHEN len(regexp_extract_all({t}, '\\S+')) > 0 THEN concat({flags}) END""".replace("{flags}", ", ".join(f"CASE WHEN {c} THEN '1' ELSE '0' END" for c in (
    f"len(regexp_extract_all({{t}}, '{url_filter.SIGNS}')) > 0.1 * len(regexp_extract_all({{t}}, '\\S+'))", "len(regexp_extract_all({t}, '!!')) > 0.1 * len(regexp_extract_all({t}, '\\S+'))",
    "length({t}) - length(replace({t}, '|', '')) > 0.1 * len(regexp_extract_all({t}, '\\S+'))", "len(list_distinct(string_split({t}, ' '))) < 0.5 * len(regexp_extract_all({t}, '\\S+'))",
)))


def _kind(text: str) -> str:
    return _KIND.replace("{t}", text)


def _url_sql() -> str:
    rules = sorted(RULES, key=lambda r: (-len(r.text), r.text))
    fits = [f"WHEN (n.host = '{r.host}' OR n.host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{{}}'" for r in rules]
    case = lambda what: "CASE " + " ".join(f.format(what(r)) for f, r in zip(fits, rules, strict=True))
    last = lambda k: f"array_to_string(list_slice(string_split(name, '.'), -{k}, -1), '.')"
    long_suffix = f"{last(2)} IN ({', '.join(map(repr, url_filter.SUFFIXES))})"
    address = "WHEN regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') THEN name"
    return f"""WITH kinds AS (SELECT kind FROM (SELECT quality, {_kind("text")} AS kind FROM documents d JOIN (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR)), quality LIMIT {url_filter.SAMPLE}) l ON d.doc_id = l.doc_id) WHERE kind IS NOT NULL GROUP BY kind HAVING 2 * (sum(1 - quality) + 1) > count(*) + 2),
    named AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
      CASE WHEN coalesce(regexp_matches(translate(url, '{url_filter.UPPER}', '{url_filter.LOWER}'), '(^|[^a-z0-9])({'|'.join(url_filter.URL_WORDS)})([^a-z0-9]|$)'), false) THEN 1 WHEN {_kind("body")} IS NOT NULL THEN CAST({_kind("body")} IN (SELECT kind FROM kinds) AS INTEGER) END AS outcome FROM
      (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest, replace(regexp_replace(html, '{url_filter.TAGS}', ' ', 'g'), '&amp;', '&') AS body FROM pages)),
    counts AS (SELECT host, CASE {address} WHEN {long_suffix} THEN {last(3)} ELSE {last(2)} END AS domain, CASE {address} WHEN {long_suffix} THEN {last(2)} ELSE {last(1)} END AS suffix, n, bad FROM
      (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name, count(outcome) AS n, coalesce(sum(outcome), 0) AS bad FROM named GROUP BY host)),
    s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(p) AS prior FROM counts, (SELECT (sum(bad) + 1) / (sum(n) + 2) AS p FROM counts) GROUP BY suffix), {_LEVEL.format(name="s1", rows="s0", keys="suffix")},
    d0 AS (SELECT d.*, a / (a + b) AS prior FROM (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM counts GROUP BY ALL) d JOIN s1 ON d.suffix = s1.suffix), {_LEVEL.format(name="d1", rows="d0", keys="domain")},
    h0 AS (SELECT c.*, a / (a + b) AS prior FROM counts c JOIN d1 ON c.domain = d1.domain), {_LEVEL.format(name="h1", rows="h0", keys="host")}
    SELECT page_id, n.host, path, {case(lambda r: r.text)} END AS rule, {case(lambda r: r.verdict)} WHEN a / (a + b) - 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
    FROM named n LEFT JOIN h1 ON n.host = h1.host"""


NGRAMS = """WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
    reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM reach GROUP BY x) r ON d.doc_id = r.x"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": NGRAMS.format(upper=url_filter.UPPER, lower=url_filter.LOWER), "op10_url_filter": _url_sql()}
