"""The contract's query for each operator, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm import bestfit, boundquant, bpecodec, collocations, fmquality, graphann, hostrules, rangecoder, revisits, secretscan, sigjoin, windowdedup, winnowing
from ravelin.llm.common import fresh_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

HOST_RULES_SQL = rf"""WITH d AS (
 SELECT doc_id, source, coalesce(text, '') AS t, {WORDS_SQL} AS ws,
 list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d
), g AS (
 SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS e, lead(w, 4) OVER o AS f
 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, e, f) AS n FROM g WHERE f IS NOT NULL
), r AS (
 SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM h WHERE n > 1) GROUP BY doc_id
), m AS (
 SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < {hostrules.MIN_WORDS} OR 100 * n_repeat_words > {hostrules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m
), hosts AS (
 SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f FROM b WHERE source IS NOT NULL GROUP BY source
), prior AS (SELECT avg(f / n) AS mean, var_pop(f / n) AS spread FROM hosts
), weighed AS (
 SELECT mean, CASE WHEN spread > 0 THEN greatest({hostrules.MIN_STRENGTH}, least({hostrules.MAX_STRENGTH}, mean * (1 - mean) / spread - 1)) ELSE {hostrules.MAX_STRENGTH} END AS weight FROM prior
), bad AS (SELECT source FROM hosts, weighed WHERE (f + mean * weight) / (n + weight) > {hostrules.MAX_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bad.source IS NOT NULL AS host_failed,
 NOT base_failed AND bad.source IS NULL AS kept FROM b LEFT JOIN bad ON b.source = bad.source"""


@query("op1_host_rules", HOST_RULES_SQL)
def op1_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hostrules.quality_rules(table(spark, sf_dir, "documents")).drop("host")


def _either_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


def _secrets_sql() -> str:
    """Starts are sums of the lengths of the gaps and matches before, as the two lists alternate."""
    parts = []
    for n, rule in enumerate(secretscan.RULES):
        pattern = rule.pattern
        if rule.ignore_case:
            names, rest = pattern[1:].split(")", 1)
            pattern = f"({_either_case(names)}){rest}"
        quoted = pattern.replace("'", "''")
        size = rf"""length(regexp_replace(m, '^[^:=]*[:=]\x20*["'']?', ''))""" if rule.value else "length(m)"
        plain = quoted.replace("(", "(?:").replace("(?:?:", "(?:")
        parts.append(f"""SELECT doc_id, {n} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
 SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda j: CAST(coalesce(list_sum(list_transform(gs[1:j], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0) AS BIGINT))) AS s
 FROM (SELECT doc_id, regexp_extract_all(t, '{plain}') AS ms, regexp_split_to_array(t, '{plain}') AS gs FROM d WHERE regexp_matches(t, '{plain}'))) WHERE {size} >= {rule.min_chars}""")
    listed = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secretscan.BASE_KINDS)
    base = ", ".join(f"'{k}'" for k in secretscan.BASE_KINDS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256({listed} FILTER (kind IN ({base})), '')) AS base_sha256, {listed} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"""


@query("op4_secret_automaton", _secrets_sql())
def op4_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest_columns(secretscan.find_secrets(table(spark, sf_dir, "documents")))


@query("op8_backtracking_bpe")
def op8_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bpecodec.load(public_tokenizers.path("byte_bpe_50k.json"))
    return bpecodec.round_trip(table(spark, sf_dir, "documents"), packed)


@query("op7_factorisation_machine")
def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmquality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SUBSTRING_SQL = rf"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS ws FROM documents
), s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {windowdedup.WINDOW} + 2)) AS i FROM d
), k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(ws[i:i + {windowdedup.WINDOW - 1}], ' ') ORDER BY doc_id, i) AS r FROM s
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {windowdedup.WINDOW})) AS p FROM k WHERE r > 1
), w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
), left_over AS (SELECT w.doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY w.p) AS kept FROM w ANTI JOIN gone ON w.doc_id = gone.doc_id AND w.p = gone.p GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON d.doc_id = left_over.doc_id"""


@query("op5_count_min_substrings", SUBSTRING_SQL)
def op5_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowdedup.removal_digests(table(spark, sf_dir, "documents"))


@query("op6_signature_join")
def op6_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigjoin.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_pruned_graph_neighbours")
def op3_pruned_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphann.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


# Crawl records of every page: one full response, and up to two revisits at other times, whose validators agree,
# disagree, are weak or are missing, by the page's number. Pages of one canonical URL answer for each other.
RECORD_COLUMNS = {
    "record_id": "page_id * 4 + n",
    "url": "url",
    "kind": "CASE WHEN n = 0 THEN 'response' ELSE 'revisit' END",
    "fetched_at": "CASE WHEN n = 0 THEN (page_id * 7919) % 86400 ELSE (page_id * 104729 + n * 40000) % 172800 END",
    "etag": """CASE WHEN n > 0 AND page_id % 7 = 0 THEN NULL WHEN n > 0 AND page_id % 5 = 0 THEN '"other"'
 WHEN n > 0 AND page_id % 3 = 2 THEN 'W/"' || substr(md5(html), 1, 8) || '"' ELSE '"' || substr(md5(html), 1, 8) || '"' END""",
    "last_modified": "CASE WHEN page_id % 11 = 0 THEN NULL WHEN n > 0 AND page_id % 13 = 0 THEN 'later' ELSE substr(md5(url), 1, 6) END",
    "payload": "CASE WHEN n = 0 THEN md5(html) END",
}
RECORDS_SQL = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in RECORD_COLUMNS.items()) + " FROM (SELECT page_id, url, html, unnest([0, 1, 2]) AS n FROM pages) WHERE n <= page_id % 3"

_CANONICAL_SQL = r"""CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN
 regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', '')
 || CASE WHEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1) END
 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END ELSE u END"""

REVISITS_SQL = f"""WITH r AS ({RECORDS_SQL}
), c AS (SELECT *, regexp_replace(trim(url), '#[^\n]*$', '') AS u FROM r
), p AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS q FROM c
), k AS (SELECT *, {_CANONICAL_SQL} AS canonical FROM p
), a AS (
 SELECT v.record_id, v.canonical AS canonical_url, v.etag, v.last_modified, v.fetched_at, max(struct_pack(t := f.fetched_at, i := f.record_id, e := f.etag, m := f.last_modified, d := f.payload)) AS f
 FROM k v LEFT JOIN k f ON v.canonical = f.canonical AND f.kind = 'response' AND f.fetched_at < v.fetched_at WHERE v.kind = 'revisit'
 GROUP BY v.record_id, v.canonical, v.etag, v.last_modified, v.fetched_at
), o AS (
 SELECT *, CASE WHEN f.i IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND f.e IS NOT NULL THEN
 CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(f.e, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
 WHEN last_modified IS NOT NULL AND f.m IS NOT NULL THEN CASE WHEN last_modified = f.m THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM a)
SELECT record_id, canonical_url, outcome, f.i AS response_id, CASE WHEN outcome = 'resolved' THEN f.d END AS payload,
 CASE WHEN outcome = 'resolved' THEN concat_ws(';', 'content-type=text/html', 'date=' || fetched_at, 'etag=' || coalesce(etag, f.e), CASE WHEN coalesce(last_modified, f.m) IS NOT NULL THEN 'last-modified=' || coalesce(last_modified, f.m) END) END AS headers
FROM o"""


def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = table(spark, sf_dir, "pages").selectExpr("page_id", "url", "html", "explode(array(0, 1, 2)) AS n").filter("n <= page_id % 3")
    records = visits.selectExpr("n", *(f"{sql} AS {name}" for name, sql in RECORD_COLUMNS.items()))
    headers = F.create_map(F.lit("content-type"), F.when(F.col("n") == 0, "text/html"), F.lit("date"), F.col("fetched_at").cast("string"), F.lit("etag"), F.col("etag"), F.lit("last-modified"), F.col("last_modified"))
    return records.withColumn("headers", F.map_filter(headers, lambda k, v: v.isNotNull())).drop("n")


@query("op2_revisit_resolution", REVISITS_SQL)
def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(crawl_records(spark, sf_dir))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.select("record_id", "canonical_url", "outcome", "response_id", "payload", listed.alias("headers"))


@query("op9_conflict_packing")
def op9_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(table(spark, sf_dir, "documents"))


@query("op10_context_mixing_ids")
def op10_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    rangecoder.write_ids(table(spark, sf_dir, "documents"), bpecodec.load(public_tokenizers.path("byte_bpe_50k.json")), path)
    return rangecoder.read_ids(spark, path).drop("ids")


_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS ws FROM documents
), b AS (SELECT item_id, ws, CASE WHEN len(ws) < {winnowing.WINDOW} THEN len(ws) ELSE {winnowing.WINDOW} END AS m FROM (SELECT item_id, {_BENCH_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0
), s AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM b)
), p AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(ws) >= m)
), h AS (SELECT doc_id, i, p.m AS m, item_id FROM p JOIN s ON p.g = s.g AND p.m = s.m
), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id
), t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""


@query("op11_winnowing", DECONTAMINATION_SQL)
def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


def _codes_sql() -> str:
    n = boundquant.PARTS
    steps = [f"""v AS (
 SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({boundquant.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (SELECT vec_id, part, q[part * (len(q) // {n}) + 1:(part + 1) * (len(q) // {n})] AS x FROM (SELECT vec_id, q, unnest(range({n})) AS part FROM v)
), c0 AS (SELECT part, e, x AS c FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {boundquant.ENTRIES})"""]
    for r in range(boundquant.ROUNDS + 1):
        steps.append(f"""a{r} AS (
 SELECT vec_id, part, x, d, e FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, part ORDER BY d, e) AS o FROM (
  SELECT vec_id, p.part AS part, x, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM p JOIN c{r} ON p.part = c{r}.part)) WHERE o = 1)""")
        if r < boundquant.ROUNDS:
            steps.append(f"""m{r} AS (
 SELECT part, e, list(m ORDER BY i) AS c FROM (SELECT part, e, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
  SELECT part, e, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{r}) GROUP BY part, e, i)) GROUP BY part, e
), c{r + 1} AS (SELECT c{r}.part AS part, c{r}.e AS e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.part = m{r}.part AND c{r}.e = m{r}.e)""")
    last = boundquant.ROUNDS
    return "WITH " + ", ".join(steps) + f""", r AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
), b AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{last}
), t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM v JOIN r ON v.vec_id = r.vec_id GROUP BY label)
SELECT v.vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN r ON v.vec_id = r.vec_id JOIN t ON v.label IS NOT DISTINCT FROM t.label CROSS JOIN b"""


@query("op12_norm_of_sum_codes", _codes_sql())
def op12_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundquant.compress_vectors(table(spark, sf_dir, "embeddings"))


COLLOCATIONS_SQL = f"""WITH t AS (
 SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\\x0A-\\x0D]+')) AS piece FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM t
), f AS (
 SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM (
  SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM p, (SELECT unnest(range(1, {collocations.LONGEST} + 1)) AS m) WHERE len(ws) >= m) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= {collocations.LEAST}
), k AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
), s AS (
 SELECT k.lang AS lang, k.phrase AS phrase, a, k, fx.f AS l, fy.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(fx.f AS HUGEINT) * fy.f) AS BIGINT) AS score
 FROM k JOIN f fx ON k.lang = fx.lang AND k.x = fx.phrase JOIN f fy ON k.lang = fy.lang AND k.y = fy.phrase
), b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1
), g AS (SELECT lang, inside, max(a) AS most FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inside FROM c WHERE m = 3) GROUP BY lang, inside
), e AS (
 SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
 FROM b LEFT JOIN g ON b.lang = g.lang AND b.phrase = g.inside WHERE most IS NULL OR 100 * most < {collocations.WITHIN_PERCENT} * a)
SELECT e.lang AS lang, rank, phrase, a, l, r, n, score FROM e JOIN n ON e.lang = n.lang WHERE rank <= {collocations.KEPT}"""


@query("op13_dynamic_phrases", COLLOCATIONS_SQL)
def op13_dynamic_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
