"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_prefix, decontam, lexical_search, license_scan, mixing, neighbour_graph, phrase_automata, probminhash, quality_ledger, resharding, suffix_dedup, url_reputation, vector_codes
from .common import cut
from .common import read_table as table


def op1_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    outcomes = url_reputation.labelled_outcomes(pages, table(spark, sf_dir, "labels"))
    return url_reputation.url_verdicts(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_ledger.with_policy(quality_ledger.ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(quality_ledger.mask(quality_ledger.BASE_RULES))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.cleaned(table(spark, sf_dir, "documents"), texts=False)


def op5_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    each = chat_prefix.examples(rows)
    loss = F.when(F.col("loss_start").isNotNull(), chat_prefix.loss_text(F.col("text"), F.col("loss_start"), F.col("loss_length")))
    each = each.select("conv_id", F.length("text").cast("long").alias("_chars"), F.struct("example", loss.alias("x")).alias("_loss"), F.when(F.col("last"), F.col("text")).alias("_last"))
    back = each.groupBy("conv_id").agg(
        F.sum("_chars").alias("formatted_chars"), F.count("*").alias("n_examples"),
        F.array_join(F.transform(F.sort_array(F.collect_list("_loss")), lambda x: x.getField("x")), "").alias("_loss"),
        F.max("_last").alias("_last"),
    ).withColumn("_turns", chat_prefix.parsed_turns(F.col("_last")))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("_turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"), F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op6_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = cut(mixing.tokenised(docs))
    budget = slim.agg(F.sum("n_tokens")).first()[0] or 0
    return mixing.mixed(docs, mixing.Mix(budget=budget), slim=slim).select("doc_id", "source", "epoch", "block_rank", "slot")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(table(spark, sf_dir, "documents"), texts=False)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in source/lang/, and one of at most 60 words licenses that directory;
    a source's directory is licensed by its documents of at most 20 words."""
    docs = table(spark, sf_dir, "documents")
    n = F.size(F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+"))
    inner = F.when(n <= 20, F.concat_ws("/", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")))
    path = F.coalesce(inner, F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")))
    files = docs.select(F.col("doc_id").alias("file"), path.alias("path"), "text", (n <= 60).alias("is_license"))
    return license_scan.licensed(files).withColumnRenamed("file", "doc_id")


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resharding.resharded(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard", "moved")


def op10_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).where("leaked").drop("leaked")


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(lexical_search.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=10)


def op12_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = neighbour_graph.usable(table(spark, sf_dir, "embeddings"))
    return neighbour_graph.search(neighbour_graph.build(vectors, k=10), vectors.where("vec_id % 100 = 0"), k=10)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.coded(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebook_digest(books)).alias("codebooks_sha256"), "label")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_probminhash_dedup, op2_url_reputation, op3_quality_ledger, op4_phrase_automata, op5_chat_prefix, op6_temperature_mixing, op7_suffix_dedup, op8_license_scan, op9_flow_resharding, op10_template_decontamination, op11_block_max_search, op12_hnsw_search, op13_vector_codes)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_url_reputation"] = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT host, CASE WHEN quality = 0 THEN 1 ELSE 0 END AS bad FROM p JOIN labels ON doc_id = try_cast(nullif(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]+)', 1), '') AS BIGINT) WHERE quality IS NOT NULL),
k AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM p)),
k2 AS (SELECT host, array_to_string(l[-2:], '.') AS two, array_to_string(l[-3:], '.') AS three, coalesce(l[-1], '') AS one FROM k),
k3 AS (SELECT host, CASE WHEN two IN ('co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN three ELSE two END AS domain, CASE WHEN two IN ('co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'org.uk') THEN two ELSE one END AS suffix FROM k2),
h AS (SELECT host, domain, suffix, CAST(count(*) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad FROM o JOIN k3 USING (host) GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
root AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 10) AS m0 FROM s),
sk AS (SELECT CASE WHEN rho IS NULL THEN 1000 ELSE greatest(2, least(1000, 1 / greatest(rho, 1e-9) - 1)) END AS k FROM (SELECT (a - b) / nullif(c - b, 0) AS rho FROM (SELECT sum(n * (bad / n - m0) * (bad / n - m0)) AS a, sum(m0 * (1 - m0)) AS b, sum(n * m0 * (1 - m0)) AS c FROM s, root WHERE n > 1))),
sp AS (SELECT suffix, (k * m0 + bad) / (k + n) AS sm, k + n AS sw FROM s, root, sk),
dk AS (SELECT CASE WHEN rho IS NULL THEN 1000 ELSE greatest(2, least(1000, 1 / greatest(rho, 1e-9) - 1)) END AS k FROM (SELECT (a - b) / nullif(c - b, 0) AS rho FROM (SELECT sum(n * (bad / n - sm) * (bad / n - sm)) AS a, sum(sm * (1 - sm)) AS b, sum(n * sm * (1 - sm)) AS c FROM d JOIN sp USING (suffix) WHERE n > 1))),
dp AS (SELECT domain, (k * sm + bad) / (k + n) AS dm, k + n AS dw FROM d JOIN sp USING (suffix), dk),
hk AS (SELECT CASE WHEN rho IS NULL THEN 1000 ELSE greatest(2, least(1000, 1 / greatest(rho, 1e-9) - 1)) END AS k FROM (SELECT (a - b) / nullif(c - b, 0) AS rho FROM (SELECT sum(n * (bad / n - dm) * (bad / n - dm)) AS a, sum(dm * (1 - dm)) AS b, sum(n * dm * (1 - dm)) AS c FROM h JOIN dp USING (domain) WHERE n > 1))),
hp AS (SELECT host, (k * dm + bad) / (k + n) AS hm, k + n AS hw FROM h JOIN dp USING (domain), hk),
q AS (SELECT host, m * w AS a, (1 - m) * w AS b, least(m0, 1 - 1e-9) AS t FROM (SELECT k3.host, coalesce(hm, dm, sm, m0) AS m, coalesce(hw, dw, sw, 10) AS w, m0 FROM k3 LEFT JOIN hp USING (host) LEFT JOIN dp USING (domain) LEFT JOIN sp USING (suffix), root)),
q2 AS (SELECT *, ln(a / b) AS top, sqrt(1 / a + 1 / b) AS sd FROM q),
q3 AS (SELECT *, top - 12.0::DOUBLE * sd AS lo, top + 12.0::DOUBLE * sd AS hi, a * top - (a + b) * ln(1 + exp(top)) AS peak FROM q2),
q4 AS (SELECT *, least(greatest(ln(t / (1 - t)), lo), hi) AS c FROM q3),
q5 AS (SELECT *, (c - lo) / 200 AS s1, (hi - c) / 200 AS s2 FROM q4),
q6 AS (SELECT host, s1 * list_sum(list_transform(range(200), lambda i: exp(a * (lo + (i + 0.5::DOUBLE) * s1) - (a + b) * ln(1 + exp(lo + (i + 0.5::DOUBLE) * s1)) - peak))) + exp(a * lo - (a + b) * ln(1 + exp(lo)) - peak) / a AS below,
  s2 * list_sum(list_transform(range(200), lambda i: exp(a * (c + (i + 0.5::DOUBLE) * s2) - (a + b) * ln(1 + exp(c + (i + 0.5::DOUBLE) * s2)) - peak))) + exp(a * hi - (a + b) * ln(1 + exp(hi)) - peak) / b AS above FROM q5),
v AS (SELECT host, above / (above + below) AS worse FROM q6),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN worse >= 0.95 THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN v USING (host) LEFT JOIN f USING (host, path)
"""

ORACLE_SQL["op3_quality_ledger"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT rid, p, w[p] || ' ' || w[p+1] || ' ' || w[p+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
r AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT p + k) AS n FROM r, (VALUES (0), (1), (2)) k(k) GROUP BY rid),
l AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclaim
  FROM d LEFT JOIN n USING (rid) LEFT JOIN l USING (rid)),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
  + CASE WHEN n_upper > 50 AND 100 * n_upper > 60 * word_chars THEN 32 ELSE 0 END + CASE WHEN n_exclaim > n_words THEN 64 ELSE 0 END AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, (failed & 47) = 0 AS kept, failed FROM f
"""

ORACLE_SQL["op5_chat_prefix"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, 25 + length(er) + length(et) AS len FROM (SELECT *, """ + "{esc_role} AS er, {esc_text} AS et" + r""" FROM c)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
x AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e),
a AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS formatted_chars FROM x GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM a
"""


_LICENSES = ", ".join(f"('{name}', {i}, '{text}')" for name, texts in license_scan.TEMPLATES.items() for i, text in enumerate(texts))
_COMMON = ", ".join(f"'{w}'" for w in sorted(license_scan.COMMON))
ORACLE_SQL["op8_license_scan"] = rf"""
WITH f AS (SELECT doc_id, text, coalesce(source, '') AS src, coalesce(lang, '') AS lang, len({_WORDS}) AS n FROM documents),
p AS (SELECT doc_id, text, CASE WHEN n <= 20 THEN src ELSE src || '/' || lang END AS dir, n <= 60 AS lic FROM f),
l AS (SELECT doc_id, unnest(list_distinct(string_split(regexp_replace(text, '{license_scan.SENTENCE_END}', '\1' || chr(30) || '\2', 'g'), chr(30)) || string_split(text, chr(10)) || regexp_split_to_array(text, '{license_scan.PARAGRAPH_END}') || CASE WHEN lic THEN [text] ELSE [] END)) AS u FROM p WHERE text IS NOT NULL),
u AS (SELECT doc_id, u, unnest(regexp_extract_all(lower(u), '{license_scan.TERM}')) AS term FROM l),
c AS (SELECT doc_id, u, term, count(*) AS tf FROM u GROUP BY ALL),
t(license, part, text) AS (VALUES {_LICENSES}),
tc AS (SELECT license, part, term, count(*) AS tf FROM (SELECT license, part, unnest(regexp_extract_all(lower(text), '{license_scan.TERM}')) AS term FROM t) GROUP BY ALL),
nn AS (SELECT count(*) AS nn FROM t),
idf AS (SELECT term, CASE WHEN term IN ({_COMMON}) THEN least(i, {license_scan.LIGHT}) ELSE i END AS idf FROM (SELECT term, ln((1.0 + nn) / (1 + count(*))) + 1 AS i FROM tc, nn GROUP BY term, nn)),
tw AS (SELECT license, part, term, (1 + ln(tf)) * idf AS w FROM tc JOIN idf USING (term)),
tn AS (SELECT license, part, sqrt(sum(w * w)) AS tn FROM tw GROUP BY ALL),
uw AS (SELECT doc_id, u, term, (1 + ln(tf)) * coalesce(idf, ln(1.0 + nn) + 1) AS w FROM c LEFT JOIN idf USING (term), nn),
un AS (SELECT doc_id, u, sqrt(sum(w * w)) AS un FROM uw GROUP BY ALL),
s AS (SELECT doc_id, u, license, max(round(dot / (un * tn), 6)) AS score FROM (SELECT doc_id, u, license, part, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (term) GROUP BY ALL) JOIN tn USING (license, part) JOIN un USING (doc_id, u) GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, license) AS r FROM s WHERE score >= {license_scan.THRESHOLD}) WHERE r = 1),
g AS (SELECT dir, arg_min(license, (-score, license)) AS gl, max(score) AS gs, count(DISTINCT license) AS n_licenses FROM p JOIN b USING (doc_id) WHERE lic GROUP BY dir),
a AS (SELECT dir, unnest([dir, string_split(dir, '/')[1], '']) AS from_dir, unnest([0, 1, 2]) AS distance FROM (SELECT DISTINCT dir FROM p)),
i AS (SELECT * FROM (SELECT a.dir, from_dir, gl, gs, n_licenses, row_number() OVER (PARTITION BY a.dir ORDER BY distance) AS r FROM a JOIN g ON g.dir = from_dir) WHERE r = 1)
SELECT p.doc_id, p.dir || '/' || p.doc_id AS path, coalesce(license, gl) AS license, CASE WHEN license IS NOT NULL THEN 'own' WHEN gl IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
  coalesce(score, gs) AS score, CASE WHEN license IS NULL THEN from_dir END AS from_dir, CASE WHEN license IS NULL THEN n_licenses END AS n_licenses
FROM p LEFT JOIN b USING (doc_id) LEFT JOIN i ON p.dir = i.dir
"""

ORACLE_SQL["op6_temperature_mixing"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS src, coalesce(text, '') AS text, CAST(len({_WORDS}) AS BIGINT) AS n, md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS m FROM documents),
t AS (SELECT src, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS tokens FROM d GROUP BY src),
l AS (SELECT list(tokens / all_tokens) AS s, any_value(all_tokens) AS b, count(*) AS k FROM (SELECT tokens, CAST(sum(tokens) OVER () AS DOUBLE) AS all_tokens FROM t WHERE tokens > 0)),
h AS (SELECT 0 AS step, 0.0::DOUBLE AS good, 1.0::DOUBLE AS bad FROM l UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE good END, CASE WHEN ok THEN bad ELSE mid END FROM (
    SELECT step, good, bad, mid, ln(z) - mid * list_sum(list_transform(s, lambda x: exp(mid * ln(x)) * ln(x))) / z >= 0.97 * ln(k) AS ok FROM (
      SELECT *, (good + bad) / 2 AS mid, list_sum(list_transform(s, lambda x: exp((good + bad) / 2 * ln(x)))) AS z FROM h, l) WHERE step < 45)),
r AS (SELECT 0 AS step, 1.0::DOUBLE AS good, 0.0::DOUBLE AS bad FROM l UNION ALL
  SELECT step + 1, CASE WHEN ok THEN mid ELSE good END, CASE WHEN ok THEN bad ELSE mid END FROM (
    SELECT step, good, bad, mid, list_max(list_transform(s, lambda x: exp(mid * ln(x)) / x)) / z <= 4.0 AS ok FROM (
      SELECT *, (good + bad) / 2 AS mid, list_sum(list_transform(s, lambda x: exp((good + bad) / 2 * ln(x)))) AS z FROM r, l) WHERE step < 45)),
e AS (SELECT greatest(CASE WHEN -list_sum(list_transform(s, lambda x: x * ln(x))) >= 0.97 * ln(k) OR k = 1 THEN 1.0 ELSE (SELECT good FROM h ORDER BY step DESC LIMIT 1) END,
  CASE WHEN list_max(list_transform(s, lambda x: 1.0 / x)) / k <= 4.0 THEN 0.0 ELSE (SELECT good FROM r ORDER BY step DESC LIMIT 1) END) AS a FROM l),
w AS (SELECT src, n_docs, tokens, p / sum(p) OVER () AS w FROM (SELECT *, exp(a * ln(tokens / b)) AS p FROM t, l, e WHERE tokens > 0)),
q AS (SELECT src, n_docs, tokens, CAST(floor(greatest(round(w * b, 3), 0)) AS BIGINT) AS q FROM w, l),
pl AS (SELECT src, n_docs, q // tokens AS f, q % tokens AS rest FROM q UNION ALL SELECT src, n_docs, 1, 0 FROM t WHERE tokens = 0),
x AS (SELECT d.*, f, rest, substring(m, 1, CAST(greatest(0, ceil(ln(n_docs / 512.0) / ln(16.0) - 1e-9)) AS INT)) AS blk FROM d JOIN pl USING (src)),
bl AS (SELECT src, blk, sum(n) AS bt, any_value(f) AS f, any_value(rest) AS rest FROM x GROUP BY ALL),
be AS (SELECT * FROM (SELECT src, blk, bt, f, rest, unnest(range(f + 1)) AS epoch FROM bl) WHERE epoch < f OR rest > 0),
bo AS (SELECT src, blk, epoch, row_number() OVER w - 1 AS block_rank, sum(bt) OVER w - bt AS before FROM be WINDOW w AS (PARTITION BY src, epoch ORDER BY md5('mix-1|' || src || '|' || epoch || '|' || blk), blk)),
o AS (SELECT x.*, epoch, block_rank, row_number() OVER w - 1 AS slot, before + sum(n) OVER (w ROWS UNBOUNDED PRECEDING) - n AS start FROM x JOIN bo USING (src, blk)
  WINDOW w AS (PARTITION BY src, blk, epoch ORDER BY md5('mix-1|' || epoch || '|' || m), m, n, md5(text)))
SELECT doc_id, source, epoch, block_rank, slot FROM o WHERE epoch < f OR start < rest
"""


def _esc(col: str) -> str:
    out = f"replace({col}, chr(92), chr(92) || chr(92))"
    for c in chat_prefix.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


ORACLE_SQL["op5_chat_prefix"] = ORACLE_SQL["op5_chat_prefix"].replace("{esc_role}", _esc("role")).replace("{esc_text}", _esc("text"))

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL["op11_block_max_search"] = rf"""
WITH d AS (SELECT * FROM (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(len(w)) AS BIGINT) AS l FROM d),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, g GROUP BY term, nn),
m AS (SELECT doc_id, rid, 100 - 75 + ((75 * len(w) * nn) // l) AS m FROM d, g),
q AS (SELECT iid, item_id, term, count(*) AS times FROM (SELECT row_number() OVER () AS iid, item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT iid, item_id, doc_id, rid, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def _codes_sql() -> str:
    """Codebooks of two rounds, written out round by round."""
    far = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"
    steps = [
        "f AS (SELECT *, row_number() OVER () AS rid FROM embeddings WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding))",
        "k AS (SELECT *, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM f WHERE len(embedding) = (SELECT len(embedding) FROM f ORDER BY vec_id NULLS LAST, embedding, label LIMIT 1))",
        "p AS (SELECT rid, vec_id, label, part, v[part * (len(v) // 16) + 1 : (part + 1) * (len(v) // 16)] AS x, embedding FROM k, (SELECT unnest(range(16)) AS part))",
        "b0 AS (SELECT part, entry, x AS c FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, embedding, label) - 1 AS entry FROM p) WHERE entry < 64)",
    ]
    for turn in range(3):
        steps.append(f"a{turn} AS (SELECT rid, part, any_value(x) AS x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (SELECT rid, part, x, entry, CAST({far} AS BIGINT) AS d FROM p JOIN b{turn} USING (part)) GROUP BY rid, part)")
        if turn < 2:
            steps.append(f"m{turn} AS (SELECT part, entry, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS y, unnest(range(1, len(x) + 1)) AS i FROM a{turn}) GROUP BY ALL)")
            steps.append(f"n{turn} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{turn} GROUP BY ALL)")
            steps.append(f"b{turn + 1} AS (SELECT part, entry, coalesce(n{turn}.c, b{turn}.c) AS c FROM b{turn} LEFT JOIN n{turn} USING (part, entry))")
    steps.append("r AS (SELECT rid, string_agg(format('{:02x}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid)")
    steps.append("h AS (SELECT sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(c) AS y, unnest(range(1, len(c) + 1)) AS i FROM b2))")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label FROM k JOIN r USING (rid), h"


ORACLE_SQL["op13_vector_codes"] = _codes_sql()
