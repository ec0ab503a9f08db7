"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, hosts, langid, lattice, lines, mtree, packing, periods, quality, repair, simhash, suffixes, warc
from quire.llm.common import stored
from quire.llm.registry import query, table

#: Added token of byte_bpe_50k.json and the id that closes a document.
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 1


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json
    pieces = packing.tokenise(documents, ranks, SPECIAL, END_ID, capacity=2048)
    digests = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    placed = packing.assign(digests, capacity=2048)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def held_out(id: str = "doc_id"):
    """Documents that no classifier learns from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = langid.fit(documents.where(~held_out()))
    found = langid.identify(documents.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op8_simhash")
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, bits=64, tau=4, m=5, chain=1, halves=True)
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


@query("op4_line_dedup", f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
totals AS (SELECT source, count(*) AS total FROM pages WHERE source IS NOT NULL GROUP BY source),
often AS (
  SELECT p.source, p.l FROM (SELECT source, unnest(list_distinct(ls)) AS l FROM pages) p JOIN totals t ON p.source = t.source
  WHERE trim(p.l, ' ') <> '' GROUP BY p.source, p.l, t.total
  HAVING count(*) >= {lines.LEAST_PAGES} AND count(*)::DOUBLE / t.total >= {lines.RATIO}),
per_host AS (SELECT source, list(l) AS gone FROM often GROUP BY source),
kept AS (
  SELECT p.doc_id, p.text, p.ls, CASE WHEN h.gone IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: NOT list_contains(h.gone, x)) END AS ks
  FROM pages p LEFT JOIN per_host h ON p.source = h.source)
SELECT doc_id, coalesce(len(ls) - len(ks), 0)::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(CASE WHEN len(ls) > len(ks) THEN array_to_string(ks, chr(10)) ELSE text END) END AS kept_sha256
FROM kept""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return kept.select("doc_id", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_suffix_array", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
c AS (SELECT w.doc_id, i, lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) AS before FROM w JOIN f ON w.s = f.s WHERE first < w.doc_id),
g AS (SELECT doc_id, i, count(*) FILTER (before IS NULL OR i - before > 50) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT r.*, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS from_here FROM r),
t AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * from_here + 1, 2 * (a - from_here)), '' ORDER BY run) || substr(any_value(h), 2 * max(b) + 1) AS kept,
    sum(b - a) AS gone, count(*) AS spans FROM d JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON d.doc_id = t.doc_id""")
def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeated_spans(table(spark, sf_dir, "documents"), size=50)
    return found.select(
        "doc_id",
        F.length("text").cast("long").alias("n_bytes"),
        (F.length("text") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: Verdict, host and path of each rule.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@query("op6_url_filter", f"""
WITH parsed AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
outcomes AS (
  SELECT p.host, CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1.0 ELSE 0.0 END AS bad
  FROM parsed p JOIN labels l ON TRY_CAST(regexp_extract(p.path, '/([0-9]+)(?:[.][a-z]+)?/?$', 1) AS BIGINT) = l.doc_id),
counts AS (SELECT host, sum(bad)::DOUBLE AS b, count(*)::DOUBLE AS n FROM outcomes GROUP BY host),
level AS (
  SELECT h.host, coalesce(c.b, 0) AS b, coalesce(c.n, 0) AS n, string_split(h.host, '.') AS ls
  FROM (SELECT DISTINCT host FROM parsed) h LEFT JOIN counts c ON h.host = c.host),
named AS (
  SELECT host, b, n, ls, CASE WHEN len(ls) > 2 AND length(ls[-1]) = 2 AND ls[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
    THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix FROM level),
full_level AS (
  SELECT *, CASE WHEN len(ls) > len(string_split(suffix, '.')) + 1 THEN array_to_string(ls[-(len(string_split(suffix, '.')) + 1):], '.') ELSE host END AS domain FROM named),
domains0 AS (SELECT suffix, domain, sum(b) AS db, sum(n) AS dn FROM full_level GROUP BY ALL),
suffixes0 AS (SELECT suffix, sum(db) AS sb, sum(dn) AS sn FROM domains0 GROUP BY suffix),
suffixes AS (SELECT *, (sb + {hosts.STRENGTH} * (SELECT (sum(sb) + 1) / (sum(sn) + 2) FROM suffixes0)) / (sn + {hosts.STRENGTH}) AS sp FROM suffixes0),
domains AS (SELECT d.*, (db + {hosts.STRENGTH} * sp) / (dn + {hosts.STRENGTH}) AS dp FROM domains0 d JOIN suffixes s ON d.suffix = s.suffix),
fitted AS (
  SELECT l.domain, l.suffix, sum(l.n * (l.b / l.n - d.dp) ** 2) AS spread, count(*)::DOUBLE AS k, sum(l.n) AS n, any_value(d.dp) AS p
  FROM full_level l JOIN domains d ON l.domain = d.domain AND l.suffix = d.suffix WHERE l.n > 0 GROUP BY l.domain, l.suffix),
strengths AS (
  SELECT domain, suffix, CASE WHEN (spread - k * p * (1 - p)) / greatest(n - k, 1.0) > 0
    THEN least(1000.0, greatest({hosts.LEAST_STRENGTH}, p * (1 - p) / ((spread - k * p * (1 - p)) / greatest(n - k, 1.0)) - 1)) ELSE {hosts.STRENGTH} END AS m FROM fitted),
posterior AS (
  SELECT l.host, (l.b + m * dp) / (l.n + m) AS mean, l.n + m AS total
  FROM (SELECT l.*, d.dp, coalesce(s.m, {hosts.STRENGTH}) AS m FROM full_level l JOIN domains d ON l.domain = d.domain AND l.suffix = d.suffix
    LEFT JOIN strengths s ON l.domain = s.domain AND l.suffix = s.suffix) l),
ruled AS (
  SELECT p.*, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM parsed p)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN mean - {hosts.DEVIATIONS} * sqrt(mean * (1 - mean) / (total + 1)) > {hosts.MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN posterior p ON r.host = p.host""")
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    number = F.regexp_extract(hosts.path_of(F.col("url")), r"/([0-9]+)(?:[.][a-z]+)?/?$", 1)  # a page names its document
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    named = pages.withColumn("_n", number).select(hosts.host_of(F.col("url")).alias("host"), F.expr("try_cast(_n AS BIGINT)").alias("doc_id"))
    outcomes = named.join(labels, "doc_id").select("host", bad.alias("bad"))
    judged = hosts.judge(pages, outcomes, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op10_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= {warc.LEAST_SHARED} AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {warc.LEAST_SHARED} AND first < page_id THEN first END AS refers_to FROM f""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write(pages)
    records = warc.read(archive, warc.lookup(archive, pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_lattice_dedup")
def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


@query("op5_mtree_topk", """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.r AS asked, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""")
def op5_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults of the task; null roles and texts are one space."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
    return rows.drop("_copy")


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair.repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    counts, said = found.conversations, repair.digests(found.pieces).withColumnRenamed("conv_id", "_said")
    joined = every.join(counts, F.col("_id").eqNullSafe(F.col("conv_id")), "left").join(said, F.col("_id").eqNullSafe(F.col("_said")), "left")
    return joined.select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ["gaps", *repair.COUNTS]],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def planted(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text) where the ends of some texts repeat themselves, as the task plants them; a document
    without an id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = documents.withColumn("_w", F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("CAST(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) div 10 AS LONG)"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rows = rows.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr("array_join(transform(sequence(0L, _n - 1), i -> _w[CAST(if(i < _a, i, _a + (i - _a) % _p) AS INT)]), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # the greatest length / period, compared exactly by cross products; runs come by start and period, so ties keep the first
    best = F.expr("aggregate(runs, CAST(NULL AS struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b IS NULL OR CAST(r.length AS DECIMAL(19,0)) * b.period > CAST(b.length AS DECIMAL(19,0)) * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    named = found.withColumn("_best", best)
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op11_quality_rules")
def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text")), "statistics")
    judged = quality.judge(found, quality.learn(found, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *quality.STATISTICS[:5], "base_failed", "kept", "rule")
