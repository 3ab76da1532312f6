"""Queries over the tables, one an operator, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, langid, line_dedup, near_dedup, packing, passages, quality, runs, secret_scan, source_audit, spm, url_filter, warc
from .common import new_folder, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: doc_id, n_ids, ids_crc32 (of the ids in decimal, blank-joined), round_trip."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = spm.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines: doc_id, n_lines, n_dropped, n_chars, text_sha256."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for every page, written and read back."""
    path = new_folder(spark, "warc")
    warc.write_archive(warc.planned(table(spark, sf_dir, "pages")), path)
    return warc.read_archive(spark, path, payload="false").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rules and the robust outlier verdict of every document."""
    out = quality.judged(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance2"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from two thirds of the labelled documents, predicted for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1
    langs, logs = langid.train(docs.filter(~held))
    return langid.predict(docs, langs, logs).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a passage that repeats across documents."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in pieces of sequences of at most 1024."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of every document and of its edited text."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base spans, all spans."""
    model = secret_scan.train(secret_scan.labelled_samples(spark))
    out = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(secret_scan.joined("spans", only_base=True), 256).alias("base_sha256"), secret_scan.joined("spans").alias("spans"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's words are from those of its language's other sources, and its terms that stand out."""
    return source_audit.audit(table(spark, sf_dir, "documents"))


#: The rules of the query, in order.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL: the longest rule's, else that of trees learned from labelled URLs."""
    rules = spark.createDataFrame(URL_RULES, url_filter.RULES)
    out = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules, url_filter.labelled_samples(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text); every tenth text by its id's CRC has words repeated periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.expr(r"regexp_extract_all(text, r'[^\x20\x09-\x0D]+', 0)")
    rows = docs.withColumn("h", h).withColumn("w", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long"))
    rows = rows.withColumn("a", F.expr("(h DIV 10) % greatest(n, 1)")).withColumn("p", F.expr("1 + (n - a) DIV (3 + (h DIV 10) % 8)"))
    repeated = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[cast(a + (i - a) % p AS int)] END), ' ')")
    return rows.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, a tenth of them made periodic; the longest run, and digests of all and of the text without repeats."""
    out = runs.detect(_with_periods(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    start, length, period = -F.col("b.start"), F.col("b.length"), -F.col("b.period")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * b.length DIV (-b.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_line_dedup, op3_warc, op4_quality_rules, op5_near_dedup, op6_language_id, op7_repeated_passages, op8_packing, op9_fingerprint, op10_secret_scan, op11_source_audit, op12_url_filter, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op11_source_audit": SOURCE_AUDIT_SQL, "op13_periodic_runs": PERIODIC_RUNS_SQL}


LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
sites AS (SELECT coalesce(source, chr(0)) AS site, count(*) AS site_pages FROM documents GROUP BY 1),
bad AS (
  SELECT site, k FROM keyed JOIN sites USING (site) WHERE k <> ''
  GROUP BY site, k, site_pages
  HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_PAGES} AND count(DISTINCT doc_id) > {line_dedup.RATIO} * site_pages),
marked AS (SELECT keyed.*, bad.k IS NOT NULL AS dropped FROM keyed LEFT JOIN bad ON keyed.site = bad.site AND keyed.k = bad.k),
clean AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '') AS text
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
       CASE WHEN d.text IS NOT NULL THEN length(c.text) END AS n_chars, CASE WHEN d.text IS NOT NULL THEN sha256(c.text) END AS text_sha256
FROM documents d LEFT JOIN clean c USING (doc_id)
"""

SOURCE_AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {source_audit.MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d
      LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) s USING (lang, source) GROUP BY d.lang, d.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + cast({source_audit.SCALE} AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p, 1 + cast({source_audit.SCALE} AS HUGEINT) * (k.n + 1) // (v.n + v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(s.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
             FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source) s
    ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
everything AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM everything)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {source_audit.TOP_TERMS}
"""

#: CRC-32 of the id's digits, bit by bit; equal words of a text joined, and the places of one distance as islands.
PERIODIC_RUNS_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         4294967295 - list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(doc_id AS VARCHAR), ''), lambda c: [cast(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS h
  FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, 3 + (h // 10) % 8 AS k FROM d),
words AS (
  SELECT r, doc_id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN w[a + (i - a) % (1 + (n - a) // k) + 1] ELSE w[i + 1] END AS word
  FROM e, unnest(range(n)) u(i)),
same AS (
  SELECT x.r, y.i - x.i AS p, x.i - row_number() OVER (PARTITION BY x.r, y.i - x.i ORDER BY x.i) AS island, x.i
  FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 2),
found AS (SELECT r, p, min(i) AS start, count(*) + p AS length FROM same GROUP BY r, p, island HAVING count(*) + p >= greatest({runs.MIN_LENGTH}, 2 * p)),
run AS (SELECT r, start, length, min(p) AS period FROM found GROUP BY r, start, length),
told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
         arg_min({{'start': start, 'length': length, 'period': period}}, {{'l': -length, 's': start, 'p': period}}) AS b
  FROM run GROUP BY r),
gone AS (SELECT DISTINCT r, i FROM run, unnest(range(start + period, start + length)) u(i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""
