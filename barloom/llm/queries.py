"""Registered queries of the corpus operators, each over its whole table, and their SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, mixing, neardup, negatives, quality, recurrent, resampling, secrets, sharding, substrings, toxicity, urls, warc
from barloom.llm.common import table

# The rules of the URL query.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = toxicity.fit(docs, labels.filter(~held))
    return (docs.select("doc_id", held.alias("held_out"), toxicity.score_column(model, F.col("text")).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.build_ledger(table(spark, sf_dir, "documents"))
    return ledger.select("doc_id", *quality.MEASURES[:5], "fail_bits", (~quality.passes(quality.POLICIES["base"])).alias("base_failed"),
                         quality.passes(quality.POLICIES["v1"]).alias("kept"))


def op2_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 contributes."""
    return quality.ablations(quality.build_ledger(table(spark, sf_dir, "documents")), quality.POLICIES["v1"])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decontam.scan_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return docs.select("doc_id", F.col("hits.n_words").alias("n_words"), hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secret_report(table(spark, sf_dir, "documents"))

    def listed(found):
        return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def number(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in secrets.BASE]
    base = F.filter("found", lambda f: f["kind"].isin(*secrets.BASE))
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
                       "n_copied", "n_live", "most_owners", "most_repositories")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponent at which no source is passed more than four times, realised over all documents."""
    return mixing.mixed_sequence(table(spark, sf_dir, "documents"), mixing.Target(repeats=4.0))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    records = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(warc.normalise(records, folder), folder)
    return found.select(F.col("key").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        F.col("type").alias("record_type"), F.col("refers").alias("refers_to"))


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return recurrent.score_documents(table(spark, sf_dir, "documents"), held)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_quality, op2_ablations, op3_mixing, op4_decontamination, op5_secrets, op6_near_duplicates, op7_warc, op8_repeated_substrings, op9_sharding, op10_urls, op11_hard_negatives, op12_resampling, op13_lm_scoring)}
ORACLES: dict[str, str] = {}

# Words are cut at the six white-space bytes; RE2 has no lookahead, so pieces are filtered instead.
_MEASURED = r"""
SELECT doc_id, words, n_words, word_chars, n_symbols, n_lines, n_lines - n_kinds AS n_dup_lines FROM (
  SELECT doc_id, w AS words, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_distinct(l)) AS BIGINT) AS n_kinds
  FROM (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
               list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents) a) b"""
_LEDGER = f"""
WITH m AS (SELECT * FROM ({_MEASURED}) z),
u AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM m),
g AS (SELECT doc_id, i, w || chr(10) || lead(w, 1) OVER d || chr(10) || lead(w, 2) OVER d AS k FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g WHERE k IS NOT NULL) a WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) AS o(o) GROUP BY doc_id),
x AS (SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, n_lines FROM m LEFT JOIN r USING (doc_id)),
ledger AS (SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
  + (CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
  + (CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END)
  + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM x)"""
ORACLES["op2_quality"] = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept FROM ledger"""
ORACLES["op2_ablations"] = _LEDGER + """
SELECT rule, CAST(count(*) FILTER (WHERE (fail_bits & bit) <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE (fail_bits & 63) <> 0) AS BIGINT) AS n_dropped,
       CAST(count(*) FILTER (WHERE (fail_bits & 63) = bit) AS BIGINT) AS n_only_this, coalesce(bit_or(fail_bits) FILTER (WHERE (fail_bits & bit) <> 0), 0) AS seen_with
FROM ledger, (VALUES ('too_short', 1), ('repeats_words', 2), ('symbols', 4), ('repeats_lines', 8), ('short_words', 16), ('long_words', 32)) AS r(rule, bit) GROUP BY rule"""

_FOLDED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op4_decontamination"] = f"""
WITH b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(10, len(w)) AS n FROM (SELECT item_id, {_FOLDED} AS w FROM benchmark WHERE text IS NOT NULL) a WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b) a),
d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) l WHERE len(w) >= n) a),
hits AS (SELECT doc_id, item, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) a GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item COLLATE "C") AS items FROM (SELECT DISTINCT doc_id, item FROM hits) a GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _kind(k: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Matches of one pattern with their places: lengths of the pieces between matches and of the matches add up."""
    return f"""SELECT doc_id, source, {k} AS k, '{kind}' AS kind, m AS matched, v AS value, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
 FROM (SELECT doc_id, source, p, ms, unnest(ms) AS m, unnest(vs) AS v, generate_subscripts(ms, 1) AS i FROM (
  SELECT doc_id, source, string_split_regex(text, '{pattern}') AS p, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS vs FROM documents WHERE text IS NOT NULL) a) b
 WHERE length(v) >= {least}"""


_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:([A-Za-z0-9+/=:,\x20\x09-\x0D]+)-----END [A-Z ]*PRIVATE KEY-----)?"
_MORE = [("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
         ("github", "gh[pousr]_[A-Za-z0-9]{36,}"), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}")]
ORACLES["op5_secrets"] = f"""
WITH f AS ({_kind(0, 'assign', _ASSIGN, 1, 8)} UNION ALL {_kind(1, 'access', 'AKIA[A-Z0-9]+', 0, 16)} UNION ALL {_kind(2, 'hex', '[0-9a-f]+', 0, 32)}

 UNION ALL SELECT doc_id, source, k, kind, matched, coalesce(nullif(regexp_replace(value, '[\\x20\\x09-\\x0D]', '', 'g'), ''), '{secrets.HEADER}') AS value, s FROM ({_kind(3, 'pem', _PEM, 1, 0)}) p
{''.join(f' UNION ALL {_kind(4 + k, kind, pattern, 0, 1)}' for k, (kind, pattern) in enumerate(_MORE))}),
o AS (SELECT value, count(DISTINCT source) AS owners, count(DISTINCT source || chr(10) || lang) AS repositories FROM f JOIN documents USING (doc_id, source) GROUP BY value),
c AS (SELECT value, n, -sum(q / n * log2(q / n)) AS bits FROM (SELECT value, length(value) AS n, ch, CAST(count(*) AS DOUBLE) AS q FROM (SELECT value, unnest(string_split(value, '')) AS ch FROM (SELECT DISTINCT value FROM f) a) b GROUP BY value, ch) e GROUP BY value, n),
v AS (SELECT doc_id, CAST(count(*) FILTER (WHERE owners >= 3) AS BIGINT) AS n_copied, CAST(count(*) FILTER (WHERE owners < 3 AND n >= 16 AND bits >= 3 AND value <> '{secrets.HEADER}') AS BIGINT) AS n_live,
             max(owners) AS most_owners, max(repositories) AS most_repositories FROM (SELECT DISTINCT doc_id, value FROM f) a JOIN o USING (value) JOIN c USING (value) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(matched) AS BIGINT), ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base,
             string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(matched) AS BIGINT), ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live, coalesce(most_owners, 0) AS most_owners, coalesce(most_repositories, 0) AS most_repositories
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN v USING (doc_id)"""

ORACLES["op10_urls"] = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
SELECT u.page_id, u.host, u.path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id, host, path)"""

_PLACE = "CAST('0x' || substr(md5('0|' || CAST(epoch AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)"
ORACLES["op3_mixing"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens FROM d GROUP BY source),
r AS (SELECT max(tokens) / min(tokens) AS spread, max(tokens) AS most FROM s WHERE tokens > 0),
bi(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN pow(spread, 1 - (lo + hi) / 2) <= 4 THEN lo ELSE (lo + hi) / 2 END, CASE WHEN pow(spread, 1 - (lo + hi) / 2) <= 4 THEN (lo + hi) / 2 ELSE hi END FROM bi, r WHERE step < 32),
a AS (SELECT hi AS a FROM bi WHERE step = 32),
p AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN CAST(round(most * pow(tokens, a) / pow(most, a)) AS BIGINT) ELSE 0 END AS budget, greatest(1, CAST(ceil(tokens / 1000000) AS BIGINT)) AS blocks FROM s, a, r),
q AS (SELECT source, tokens, blocks, CAST(CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS BIGINT) AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM p),
l AS (SELECT doc_id, source, n_tokens, blocks, epochs, rest, {_PLACE} AS place FROM (SELECT *, epochs AS epoch FROM d JOIN q USING (source)) x),
t AS (SELECT *, epochs + CASE WHEN rest > 0 AND sum(n_tokens) OVER (PARTITION BY source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest THEN 1 ELSE 0 END AS copies FROM l),
i AS (SELECT doc_id, source, n_tokens, blocks, unnest(generate_series(0, copies - 1)) AS epoch FROM t),
b AS (SELECT doc_id, source, n_tokens, CAST(epoch AS BIGINT) AS epoch, blocks, {_PLACE} AS place FROM i),
c AS (SELECT *, CAST(floor(CAST(place AS DOUBLE) * blocks / 1152921504606846976.0) AS BIGINT) AS block FROM b)
SELECT doc_id, source, n_tokens, epoch, block, row_number() OVER (PARTITION BY source, epoch, block ORDER BY place, doc_id, n_tokens) - 1 AS slot FROM c"""

# Base32 of the 160 bits of the digest: each group of 5 bits is a letter.
ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT html, min(page_id) AS first FROM h GROUP BY html),
b AS (SELECT hex, string_agg(CASE c WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
  WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END, '' ORDER BY i) AS bits
  FROM (SELECT hex, i, substr(hex, CAST(i AS INTEGER), 1) AS c FROM (SELECT DISTINCT hex FROM h) x, range(1, 41) AS r(i)) y GROUP BY hex),
e AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER)
  + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER), 1), '' ORDER BY i) AS payload_digest FROM b, range(0, 32) AS r(i) GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h JOIN g USING (html) JOIN e USING (hex)"""


# CRC-32 byte by byte: the 256 entries follow from the published polynomial by eight shifts each.
_CRC = """crc_table AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)) z)"""


def _crc(hexed: str) -> str:
    """Unsigned CRC-32 of the bytes in `hexed`, a column of upper-case hex digits; needs crc_table in FROM."""
    return f"""xor(list_reduce(range(CAST(length({hexed}) // 2 AS BIGINT)), lambda c, i: xor(c // 256, crc[CAST(xor(c % 256, CAST('0x' || substr({hexed}, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS INTEGER) + 1]), 4294967295), 4294967295)"""


ORACLES["op12_resampling"] = f"""
WITH {_CRC},
w AS (SELECT doc_id, {_FOLDED} AS w FROM documents WHERE text IS NOT NULL),
x AS (SELECT unnest({_FOLDED}) AS w FROM benchmark WHERE text IS NOT NULL),
d AS (SELECT doc_id, unnest(w) AS w FROM w),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM d UNION SELECT w FROM x) a),
b AS (SELECT w, {_crc("h")} % 10000 AS b FROM v, crc_table),
s AS (SELECT b, CAST(count(*) AS DOUBLE) AS s FROM d JOIN b USING (w) GROUP BY b),
t AS (SELECT b, CAST(count(*) AS DOUBLE) AS t FROM x JOIN b USING (w) GROUP BY b),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS s_all, coalesce((SELECT sum(t) FROM t), 0) AS t_all),
g AS (SELECT r.b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (s_all + 10000)) / ((coalesce(s, 0) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM range(10000) r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), n),
k AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM d JOIN b USING (w) JOIN g USING (b) GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN k USING (doc_id)),
e AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM c),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS take FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= take THEN place END AS BIGINT) AS rank FROM e LEFT JOIN o USING (doc_id)"""


ORACLES["op11_hard_negatives"] = """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id AS positive, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score QUALIFY rank <= 10"""


# Every pair of documents that share a shingle, counted on the whole sets; reachable documents by repeated steps along links.
ORACLES["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w WHERE len(w) > 0) a),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
