"""URL filters: rules for hosts and paths, and gradient-boosted trees for the URLs that no rule covers.

A rule (host, path, verdict) covers its host and all subdomains where the URL's path starts with the rule's; of several the
longest counts. Rules are matched by joining the suffixes of distinct hosts with the rules' hosts, so neither list is
broadcast by assumption and each URL is joined once. The trees are learned from labelled URLs on lexical features: lengths,
depth, hyphens, digit ratio, entropy, parameter counts, and statistics of the host's suffixes, i.e. how many labelled URLs
have a suffix and how many of them are blocked (suffixes of fewer than MIN_SEEN labelled ones count as unknown: their share
would tell the label of the row itself). About TRAIN_ROWS labelled URLs are learned from at most, chosen by hash; rules and
verdicts cover all rows.

``labelled_samples`` makes labelled URLs by rule: ordinary ones, and four kinds of unwanted ones (hosts of hyphenated words,
random hosts, tracking links, deep paths of random tokens), each with one such trait only.

Null URLs and those without ``://`` have empty host and path, no rule, and the trees' verdict on their features. Repeated
rows are judged each. Without labelled URLs everything is allowed; if all labels are equal, all others get that verdict.
An empty table gives no rows. Other columns pass through; host, path, rule, verdict and score are replaced, and columns
whose names begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_per_key, written

#: About so many labelled URLs are learned from at most; the statistics of suffixes have fewer rows than that.
TRAIN_ROWS = 20_000
#: Trees, their depth, and the share of blocked URLs from which on a URL is blocked.
TREES, DEPTH, THRESHOLD = 20, 4, 0.5
#: A suffix counts as if it had so many more URLs with the average share of blocked ones.
SMOOTHING = 5.0
#: Suffixes of fewer labelled URLs than this are unknown.
MIN_SEEN = 50

ALLOW, BLOCK = "allow", "block"
LEXICAL = ["length", "host_length", "labels", "hyphens", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters", "longest_segment"]
SUFFIX = ["blocked_1", "seen_1", "blocked_2", "seen_2"]
RULES = "host string, path string, verdict string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host and path."""
    rest = F.expr(f"CASE WHEN contains({url_col}, '://') THEN substring({url_col}, instr({url_col}, '://') + 3) ELSE '' END")
    part = lambda i: F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", i), F.lit(""))
    return urls.withColumn("__host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2)).drop("host").withColumnRenamed("__host", "host")


def covering(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path) with __rule: struct (rule, verdict) of the longest rule that covers them, or null."""
    own = rules.select(F.translate("host", _UPPER, _LOWER).alias("__suffix"), F.struct(F.concat("host", "path").alias("rule"), F.col("path").alias("path"), "verdict").alias("r"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("__n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # Hosts without rules stay in it, so that the join knows how many rows each of them has.
    met = hosts.select("host", "__n", F.explode(suffixes).alias("__suffix")).join(own, "__suffix", "left").groupBy("host", "__n").agg(F.collect_list("r").alias("__rules"))
    joined = join_per_key(rows, met, ["host"], "__n", "left")
    fits = F.filter("__rules", lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("l"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return joined.withColumn("__rule", longest).drop("__rules", "__n")


def _entropy(text: str) -> Column:
    """Bits a character."""
    share = f"(length({text}) - length(replace({text}, c, ''))) / length({text})"
    return F.expr(f"CASE WHEN length({text}) > 0 THEN aggregate(array_distinct(split({text}, '')), 0D, (a, c) -> a - CASE WHEN c = '' THEN 0D ELSE {share} * log2({share}) END) ELSE 0D END")


def with_features(rows: DataFrame, url_col: str = "url") -> DataFrame:
    """``rows`` (host, path) with the lexical features __f, and __s1 and __s2: the host's last label and its last two."""
    url = f"coalesce({url_col}, '')"
    segments = "filter(split(path, '/'), s -> s <> '')"
    query = f"regexp_extract({url}, r'^[^?#]*[?]([^#]*)', 1)"
    values = {
        "length": F.expr(f"length({url})"),
        "host_length": F.length("host"),
        "labels": F.expr("size(filter(split(host, '[.]'), s -> s <> ''))"),
        "hyphens": F.expr("length(host) - length(replace(host, '-', ''))"),
        "depth": F.expr(f"size({segments})"),
        "digit_ratio": F.expr(f"length(regexp_replace({url}, '[^0-9]', '')) / greatest(length({url}), 1)"),
        "host_digits": F.expr("length(regexp_replace(host, '[^0-9]', '')) / greatest(length(host), 1)"),
        "entropy": _entropy(url),
        "host_entropy": _entropy("host"),
        "parameters": F.expr(f"size(filter(split({query}, '&'), s -> s <> ''))"),
        "longest_segment": F.expr(f"coalesce(array_max(transform({segments}, s -> length(s))), 0)"),
    }
    last = lambda n: F.substring_index("host", ".", -n)
    return rows.withColumn("__f", F.struct(*[values[n].cast("double").alias(n) for n in LEXICAL])).withColumn("__s1", last(1)).withColumn("__s2", last(2))


class UrlModel:
    """Boosted trees with the statistics of suffixes that they were learned with; ``constant`` where there are none."""

    def __init__(self, suffixes: list[DataFrame] | None = None, share: float = 0.0, trees: PipelineModel | None = None):
        self.suffixes, self.share, self.trees = suffixes, share, trees

    def _vectors(self, featured: DataFrame) -> DataFrame:
        rows = featured
        for n, statistics in zip((1, 2), self.suffixes, strict=True):
            rows = rows.join(F.broadcast(statistics), f"__s{n}", "left")  # fewer rows than TRAIN_ROWS
            rows = rows.withColumn(f"__blocked_{n}", F.coalesce(f"__blocked_{n}", F.lit(self.share))).withColumn(f"__seen_{n}", F.log1p(F.coalesce(f"__seen_{n}", F.lit(0))))
        return rows.select(*[c for c in rows.columns if not c.startswith(("__blocked_", "__seen_"))], *[F.col(f"__f.{n}").alias(f"__x_{n}") for n in LEXICAL], *[F.col(f"__{n}").cast("double").alias(f"__x_{n}") for n in SUFFIX])

    def score(self, featured: DataFrame) -> DataFrame:
        """``featured`` with score, the trees' share of blocked ones (0 to 1)."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(self.share))
        out = self.trees.transform(self._vectors(featured)).withColumn("score", vector_to_array("__probability")[1])
        return out.select(*[c for c in featured.columns if c != "score"], "score")


def train(spark: SparkSession, labelled: DataFrame, url_col: str = "url", train_rows: int = TRAIN_ROWS) -> UrlModel:
    """Learns from ``labelled`` (host, path, the URL, blocked boolean), of which about ``train_rows`` are chosen by hash."""
    known = labelled.filter("blocked IS NOT NULL")
    sizes = known.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("blocked").cast("double")), F.lit(0.0)).alias("share")).first()
    if sizes["share"] in (0.0, 1.0):
        return UrlModel(share=sizes["share"])
    chosen = known.filter(F.pmod(F.xxhash64(F.col(url_col), F.lit(12)), F.lit(1 << 20)) < int(min(1.0, train_rows / sizes["n"]) * (1 << 20)))
    # A bounded number of narrow rows, in one file and one order, so that repeated runs learn the same trees.
    sample = written(with_features(chosen.dropDuplicates([url_col, "blocked"]), url_col).select("__f", "__s1", "__s2", F.col("blocked").cast("double").alias("__label")).repartition(1).sortWithinPartitions("__s2", "__f", "__label"), "url-sample")
    share = sample.agg(F.avg("__label")).first()[0]
    if share in (None, 0.0, 1.0):
        return UrlModel(share=sizes["share"] if share is None else share)
    suffixes = []
    for n in (1, 2):
        counted = sample.groupBy(f"__s{n}").agg(F.count("*").alias(f"__seen_{n}"), F.sum("__label").alias("__b")).filter(F.col(f"__seen_{n}") >= MIN_SEEN)
        suffixes.append(written(counted.select(f"__s{n}", f"__seen_{n}", ((F.col("__b") + SMOOTHING * share) / (F.col(f"__seen_{n}") + SMOOTHING)).alias(f"__blocked_{n}")).coalesce(1), "url-suffixes"))
    model = UrlModel(suffixes, share)
    steps = [
        VectorAssembler(inputCols=[f"__x_{n}" for n in LEXICAL + SUFFIX], outputCol="__features"),
        GBTClassifier(featuresCol="__features", labelCol="__label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=12, predictionCol="__prediction").setRawPredictionCol("__raw").setProbabilityCol("__probability"),
    ]
    model.trees = Pipeline(stages=steps).fit(model._vectors(sample).coalesce(1))
    return model


#: Fixed values of the labelled samples: syllables of their words, and suffixes of both classes (common ones in both).
_SYLLABLES = ["ba", "ter", "lo", "min", "sa", "ring", "to", "ven", "ka", "del", "po", "stan", "ri", "mu", "gel", "no", "fra", "li", "hor", "web"]
_SUFFIXES = ["com", "net", "org", "de", "fr", "info"]
_CHEAP = ["com", "net", "org", "info", "xyz", "top"]
SAMPLES = 4_000


def labelled_samples(spark: SparkSession, per_class: int = SAMPLES, salt: int = 0) -> DataFrame:
    """(url, blocked): made by rule from hashes of row numbers; another ``salt`` gives other URLs."""
    number = lambda k, n, i="id": f"pmod(xxhash64({i}, {k}, {salt}), {n})"
    pick = lambda values, k, i="id": f"element_at(array({', '.join(repr(v) for v in values)}), cast({number(k, len(values), i)} + 1 AS int))"
    word = lambda k, i="id": f"concat({pick(_SYLLABLES, k, i)}, {pick(_SYLLABLES, k + 1, i)}, CASE WHEN {number(k + 2, 2, i)} = 0 THEN {pick(_SYLLABLES, k + 3, i)} ELSE '' END)"
    token = lambda k, size, i="id": f"substring(translate(base64(unhex(sha2(concat({i}, '-{k}-{salt}'), 256))), '+/=', 'xyz'), 1, {size})"
    below = lambda k: f"CASE WHEN {number(k, 3)} = 0 THEN '' ELSE concat({pick(['www', 'm', 'blog', 'shop', 'news'], k + 1)}, '.') END"
    parameters = lambda k, least, most: f"concat('?', array_join(transform(sequence(1, cast({least} + {number(k, most - least + 1)} AS int)), j -> concat({word(k + 1, 'concat(id, j)')}, '=', {number(k + 6, 1000, 'concat(id, j)')})), '&'))"
    path = f"concat('/', array_join(transform(sequence(1, cast(1 + {number(40, 3)} AS int)), j -> {word(41, 'concat(id, j)')}), '/'), CASE {number(46, 4)} WHEN 0 THEN concat('/', {number(47, 300000)}) WHEN 1 THEN concat('/', {number(47, 3000)}, '.html') WHEN 2 THEN '/' ELSE '' END)"
    query = f"CASE {number(50, 4)} WHEN 0 THEN {parameters(51, 1, 2)} WHEN 1 THEN '#top' ELSE '' END"
    host = f"concat({below(1)}, {word(3)}, CASE WHEN {number(8, 2)} = 0 THEN concat('.', {word(9)}) ELSE '' END, '.')"
    plain = f"concat({host}, {pick(_SUFFIXES, 15)})"
    hyphens = f"concat({below(1)}, {word(3)}, '-', {word(20)}, CASE WHEN {number(25, 3)} = 0 THEN concat('-', {word(26)}) ELSE '' END, CASE WHEN {number(8, 2)} = 0 THEN concat('.', {word(9)}) ELSE '' END, '.', {pick(_CHEAP, 15)})"
    random = f"concat(lower({token(30, 16)}), {number(31, 1000)}, '.', {pick(_CHEAP, 15)})"
    tracking = f"concat({plain}, {path}, {parameters(60, 5, 9)}, '&sid=', {token(61, 24)})"
    deep = f"concat({plain}, '/', array_join(transform(sequence(1, cast(6 + {number(70, 4)} AS int)), j -> {token(71, 12, 'concat(id, j)')}), '/'), {query})"
    good = f"concat({plain}, {path}, {query})"
    bad = f"CASE pmod(id, 4) WHEN 0 THEN concat({hyphens}, {path}, {query}) WHEN 1 THEN concat({random}, {path}, {query}) WHEN 2 THEN {tracking} ELSE {deep} END"
    scheme = f"CASE WHEN {number(80, 3)} = 0 THEN 'http://' ELSE 'https://' END"
    rows = spark.range(2 * per_class).withColumn("blocked", F.col("id") >= per_class)
    return rows.select(F.expr(f"concat({scheme}, CASE WHEN blocked THEN {bad} ELSE {good} END)").alias("url"), "blocked")


def judge(urls: DataFrame, rules: DataFrame, labelled: DataFrame, url_col: str = "url", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``urls`` with host, path, rule, verdict and score (null where a rule decides). ``rules``: (host, path, verdict).
    ``labelled`` (url, blocked) is what the trees learn from."""
    model = train(urls.sparkSession, with_host(labelled.select("url", "blocked")), "url", train_rows)
    covered = covering(with_host(urls.drop("rule", "verdict", "score"), url_col), rules)
    out = model.score(with_features(covered, url_col))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") >= THRESHOLD, BLOCK).otherwise(ALLOW))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "score")]
    return out.select(*kept, "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("__rule").isNull(), F.col("score")).alias("score"))
