"""Scalar functions, filters and duplicates over the stand-in facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recallgrid.functions import text
from recallgrid.operators import consolidate, context
from recallgrid.sources import readers

from . import standins as s
from .registry import query

_SIGNS = text.EDGE_SIGNS.replace("'", "''")
_SQUEEZE = "trim(regexp_replace(lower(content), '\\s+', ' ', 'g'))"
_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: length(w) > 0)"


@query("SELECT doc_id, source, lang FROM documents WHERE n_chars BETWEEN 200 AND 2000")
def scan_columns(spark, sf):
    return s.table(spark, sf, "documents").where("n_chars BETWEEN 200 AND 2000").select("doc_id", "source", "lang")


@query(f"WITH {s.FACTS} SELECT fact_id, substring({_SQUEEZE}, 1, 160) AS key, length({_SQUEEZE}) AS size FROM facts")
def normalized_text(spark, sf):
    return s.facts(spark, sf).select("fact_id", text.dedupe_key(F.col("content")).alias("key"), F.length(text.squeeze(F.col("content"))).cast("bigint").alias("size"))


_TOK = f"list_distinct(list_transform(list_filter({_WORDS.format('x')}, lambda w: length(w) > 2), lambda w: lower(trim(w, '{_SIGNS}'))))"


@query(f"""WITH t AS (SELECT doc_id, substring(text, 1, 300) AS x FROM documents), k AS (SELECT doc_id, {_TOK} AS tokens FROM t)
SELECT a.doc_id, CAST(len(a.tokens) AS BIGINT) AS n,
  CASE WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0.0 ELSE round(len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))), 6) END AS jaccard
FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""")
def token_jaccard(spark, sf):
    k = s.table(spark, sf, "documents").select("doc_id", text.tokens(F.substring("text", 1, 300)).alias("tokens"))
    b = k.select((F.col("doc_id") - 1).alias("doc_id"), F.col("tokens").alias("other"))
    return k.join(b, "doc_id").select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.round(text.jaccard(F.col("tokens"), F.col("other")), 6).alias("jaccard"))


#: Spelled out here, apart from the list that the function uses.
_STOP = """['a', 'about', 'again', 'all', 'am', 'an', 'and', 'any', 'are', 'as', 'at', 'be', 'been', 'being', 'both', 'but', 'by', 'can', 'could', 'did', 'do', 'does', 'doing', 'down',
 'each', 'else', 'few', 'for', 'from', 'further', 'had', 'has', 'have', 'having', 'he', 'her', 'here', 'him', 'his', 'how', 'i', 'if', 'in', 'into', 'is', 'it', 'its', 'just',
 'me', 'more', 'most', 'my', 'no', 'nor', 'not', 'of', 'off', 'on', 'once', 'only', 'or', 'other', 'our', 'out', 'over', 'own', 'same', 'she', 'should', 'so', 'some', 'such',
 'than', 'that', 'the', 'their', 'them', 'then', 'there', 'these', 'they', 'this', 'those', 'to', 'too', 'under', 'up', 'us', 'very', 'was', 'we', 'were', 'what', 'when',
 'which', 'while', 'who', 'whom', 'whose', 'why', 'will', 'with', 'would', 'you', 'your']"""
#: Mail addresses and runs of digits, likewise.
_PERSONAL = r"[0-9][-0-9().\s]{7,}[0-9]|[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_]"


@query(f"""WITH t AS (SELECT doc_id, lower(substring(text, 1, 400)) AS x FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform({_WORDS.format('x')}, lambda w: trim(w, '{_SIGNS}')), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w)), ' ') AS words FROM t
UNION ALL SELECT -1, 'where above below'""")
def content_words(spark, sf):
    d = s.table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 400).alias("x"))
    d = d.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("Where, above (and) below; the is; " + " ".join(text.STOP_WORDS))))
    return d.select("doc_id", text.content_words(F.col("x")).alias("words"))


@query("SELECT doc_id, substring(sha256(text), 1, 12) AS h12, substring(sha256(text), 1, 16) AS id, 'holo_fact_' || doc_id AS vid FROM documents")
def text_hashes(spark, sf):
    return s.table(spark, sf, "documents").select("doc_id", text.short_hash(F.col("text")).alias("h12"), text.short_hash(F.col("text"), 16).alias("id"), text.vector_id("holo_fact_", F.col("doc_id")).alias("vid"))


_FORMS = "|".join(text.LEGAL_FORMS)


@query(f"""WITH n AS (SELECT c_custkey, 'The ' || replace(c_name, '#', ' - ') || CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' GmbH & Co' ELSE '' END AS name FROM customer),
m AS (SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[-_.,:;|/&()''"]+', ' ', 'g'), '\\b({_FORMS})\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS m FROM n)
SELECT c_custkey, CASE WHEN starts_with(m, 'the ') THEN trim(substring(m, 5)) ELSE m END AS norm FROM m""")
def normalize_name(spark, sf):
    c = s.table(spark, sf, "customer")
    tail = F.when(F.col("c_custkey") % 4 == 0, ", Inc.").when(F.col("c_custkey") % 4 == 1, " LLC").when(F.col("c_custkey") % 4 == 2, " GmbH & Co").otherwise("")
    name = F.concat(F.lit("The "), F.replace("c_name", F.lit("#"), F.lit(" - ")), tail)
    return c.select("c_custkey", text.normalize_name(name).alias("norm"))


@query("""WITH u AS (SELECT page_id, lower(trim(url)) AS u FROM pages),
h AS (SELECT page_id, trim(split_part(regexp_replace(split_part(regexp_replace(u, '^[a-z]+://', ''), '/', 1), '^www\\.', ''), ':', 1)) AS h FROM u)
SELECT page_id, CASE WHEN contains(h, '.') AND length(h) BETWEEN 3 AND 60 THEN h END AS domain FROM h""")
def url_domain(spark, sf):
    return s.table(spark, sf, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


@query("""WITH d AS (SELECT doc_id, regexp_replace(substring(text, 1, 2000), '[^0-9]', '', 'g') AS digits FROM documents)
SELECT doc_id, CASE WHEN length(digits) >= 10 THEN right(digits, 10) END AS phone FROM d""")
def phone_keys(spark, sf):
    return s.table(spark, sf, "documents").select("doc_id", text.phone_key(F.substring("text", 1, 2000)).alias("phone"))


@query("""WITH r AS (SELECT s_suppkey AS id, 'supplier ' || s_suppkey AS norm, 'mail' || s_suppkey || '@host' || (s_suppkey % 7) || '.example.com' AS email, '+1 (555) 010-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS phone FROM supplier),
k AS (SELECT id, unnest(['domain:' || split_part(email, '@', 2), 'email:' || email, 'phone:' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 10), 'norm:' || norm]) AS key FROM r)
SELECT key, count(*) AS n, min(id) AS first FROM k GROUP BY key""")
def merge_keys(spark, sf):
    r = s.table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    email = F.concat(F.lit("mail"), key, F.lit("@host"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".example.com"))
    keys = text.merge_keys(F.concat(F.lit("supplier "), key), F.lit(None).cast("string"), email, F.concat(F.lit("+1 (555) 010-"), F.lpad(key, 4, "0")))
    return r.select("s_suppkey", F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 2 THEN NULL ELSE vec_id END AS fact_id FROM embeddings""")
def fact_id_of_vid(spark, sf):
    v = s.table(spark, sf, "embeddings")
    prefix = F.when(F.col("vec_id") % 3 == 0, "holo_fact_").when(F.col("vec_id") % 3 == 1, "gist_").otherwise("situation_")
    return v.select("vec_id", text.fact_id_of(F.concat(prefix, F.col("vec_id").cast("string"))).alias("fact_id"))


@query(f"""WITH {s.FACTS} SELECT fact_id, regexp_matches(content, '{_PERSONAL}') AS personal, regexp_matches(content, '{text.DURABLE.replace("'", "''")}') AS durable,
 (retrieval_count > 0 OR helpful_count > 0 OR trust_score > 0.5) AS protected, contains(content, 'Voice call just ended') AS junk FROM facts""")
def fact_flags(spark, sf):
    c = F.col("content")
    return s.facts(spark, sf).select("fact_id", text.shows_personal(c).alias("personal"), text.is_durable(c).alias("durable"), text.is_protected(F.col("retrieval_count"), F.col("helpful_count"), F.col("trust_score")).alias("protected"), text.is_junk(c).alias("junk"))


@query(f"""WITH {s.FACTS} SELECT fact_id, length(content) AS size, CASE WHEN length(content) > 220 THEN substring(content, 1, 217) || '...' ELSE content END AS short,
 regexp_replace(substring(content, 1, 80), '["]', '''', 'g') AS label FROM facts WHERE NOT regexp_matches(content, '{_PERSONAL}') AND length(content) BETWEEN 20 AND 160""")
def sample_texts(spark, sf):
    c = F.col("content")
    rows = s.facts(spark, sf).where(~text.shows_personal(c) & F.length(c).between(20, 160))
    return rows.select("fact_id", F.length(c).cast("bigint").alias("size"), text.ellipsis(c).alias("short"), text.safe_label(F.substring(c, 1, 80)).alias("label"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing, props AS object FROM events""")
def json_fields(spark, sf):
    e = s.table(spark, sf, "events")
    v = F.try_parse_json("props")
    return e.select("event_id", F.try_variant_get(v, "$.k", "string").alias("k"), F.try_variant_get(F.try_parse_json(F.concat(F.lit("x"), "props")), "$.k", "string").alias("missing"), text.first_json_object(F.concat(F.lit("so: "), "props", F.lit(" end"))).alias("object"))


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), t AS (SELECT doc_id, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS x FROM p)
SELECT doc_id, count(*) AS sections, CAST(sum(length(x)) AS BIGINT) AS chars FROM t WHERE x <> '' GROUP BY doc_id""")
def sections(spark, sf):
    rows = readers.split_sections(s.table(spark, sf, "documents").select("doc_id", "text"), "\n")
    return rows.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.length("section")).alias("chars"))


@query("SELECT vec_id % 20 AS g, substring(sha256(array_to_string(list(vec_id ORDER BY vec_id), ',')), 1, 12) AS signature FROM embeddings GROUP BY vec_id % 20")
def cluster_signatures(spark, sf):
    return s.table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 20).alias("g")).agg(F.collect_list("vec_id").alias("ids")).select("g", text.cluster_signature(F.col("ids")).alias("signature"))


@query("""SELECT o_orderkey, trim(substring(o_orderpriority, 1, 80)) || ' (' || strftime(o_orderdate, '%Y-%m-%d') || ')' AS name FROM orders""")
def event_names(spark, sf):
    return s.table(spark, sf, "orders").select("o_orderkey", text.event_name(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("name"))


_RANKED = f"""WITH {s.FACTS}, n AS (SELECT *, {_SQUEEZE} AS t FROM facts),
r AS (SELECT fact_id, first_value(fact_id) OVER (PARTITION BY t ORDER BY helpful_count DESC, retrieval_count DESC, trust_score DESC, fact_id) AS keeper FROM n WHERE t <> '')"""


@query(f"{_RANKED} SELECT fact_id, keeper FROM r WHERE fact_id <> keeper")
def duplicate_facts(spark, sf):
    return consolidate.duplicates(s.facts(spark, sf))


@query(f"""{_RANKED}, d AS (SELECT fact_id FROM r WHERE fact_id <> keeper) SELECT 'duplicate' AS reason, count(*) AS n FROM d
UNION ALL SELECT 'junk:call-transcript', count(*) FROM facts WHERE contains(content, 'Voice call just ended') AND helpful_count = 0 AND retrieval_count = 0 AND trust_score <= 0.5 AND fact_id NOT IN (SELECT fact_id FROM d)""")
def archive_counts(spark, sf):
    return consolidate.archive(s.facts(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT conv_id, turn, substring(text, 1, 300) AS message FROM conversations WHERE role = 'user' AND text IS NOT NULL),
f AS (SELECT * FROM (SELECT *, lag(message) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m) WHERE before IS NULL OR before <> message)
SELECT conv_id, turn, string_agg(message, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS "window" FROM f""")
def rolling_queries(spark, sf):
    return context.rolling_queries(s.table(spark, sf, "conversations"))


@query("""WITH l AS (SELECT conv_id, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS block, turn AS line, '- ' || substring(text, 1, 120) AS text, false AS header FROM conversations WHERE text IS NOT NULL),
h AS (SELECT DISTINCT conv_id, block, CAST(-1 AS BIGINT) AS line, '## block ' || block AS text, true AS header FROM l),
u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY block, line) AS used FROM (SELECT * FROM l UNION ALL SELECT * FROM h)),
k AS (SELECT *, sum(CASE WHEN header THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, block) AS body FROM u WHERE used <= 500)
SELECT conv_id, block, line, text, header FROM k WHERE body > 0""")
def capped_context(spark, sf):
    c = s.table(spark, sf, "conversations").where("text IS NOT NULL")
    block = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    lines = c.select("conv_id", block.alias("block"), F.col("turn").alias("line"), F.concat(F.lit("- "), F.substring("text", 1, 120)).alias("text"), F.lit(False).alias("header"))
    heads = lines.select("conv_id", "block").distinct().select("conv_id", "block", F.lit(-1).cast("bigint").alias("line"), F.concat(F.lit("## block "), F.col("block").cast("string")).alias("text"), F.lit(True).alias("header"))
    return context.cap_lines(lines.union(heads), 500, ["conv_id"])


@query(f"""WITH {s.FACTS}, d AS (SELECT fact_id, trust_score, string_split({_SQUEEZE}, ' ') AS words FROM facts),
t AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM d),
h AS (SELECT fact_id, len(words) AS size, w, count(*) AS tf FROM (SELECT fact_id, words, unnest(words) AS w FROM d) WHERE w IN ('the', 'license', 'mit') GROUP BY ALL),
f AS (SELECT w, count(*) AS df FROM h GROUP BY w),
s AS (SELECT fact_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM h JOIN f USING (w) CROSS JOIN t GROUP BY fact_id)
SELECT fact_id, round(score, 6) AS score FROM s JOIN d USING (fact_id) WHERE trust_score >= 0.3 ORDER BY round(score, 6) DESC, fact_id LIMIT 12""")
def search_facts(spark, sf):
    return context.search_facts(s.facts(spark, sf), "the MIT license").select("fact_id", "score")
