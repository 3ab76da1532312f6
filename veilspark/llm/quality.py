"""Quality rules: fixed base rules, and robust multivariate outliers by minimum covariance determinant.

Documents are described by a vector of transformed statistics. For each language and source (small groups are pooled by
language, then all together) the covariance matrix of least determinant over H of the group's documents is sought by
concentration steps from a median and MAD start, then reweighted; a document whose Mahalanobis distance from its
group's robust centre exceeds a chi-square quantile is rejected. Everything is DataFrame expressions: sums, products
and counts of quantised values, all of which merge before a shuffle, so a hot source costs a row a task.

Null text has no words and fails the base; null language or source form groups of their own; repeated rows count each;
an empty table gives no rows; other columns are ignored. Documents of a pool below MIN_GROUP rows are kept (no estimate).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, join_per_key, written

#: What separates words.
SPACE = r"[\x20\x09-\x0D]"
SPACES = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
#: Share of a group that the least determinant is sought over, and the steps taken to it.
H, STEPS = 0.75, 3
#: A document is rejected beyond this quantile of the chi-square distribution.
CUTOFF = 1 - 1e-9
#: Groups with fewer documents are pooled.
MIN_GROUP = 50
#: name: (SQL over the statistics, least standard deviation). Counts are shrunk towards clean text by pseudo-words, so short texts vary less.
FEATURES = {
    "word_length": ("ln((word_chars + 5 * 50) / (n_words + 50))", 0.12),
    "symbols": ("ln(1 + 20 * n_symbols / (n_words + 20))", 0.10),
    "upper": ("ln(1 + 20 * n_upper / (word_chars + 100))", 0.25),
    "marks": ("ln(1 + 4 * n_marks / (n_words + 20))", 0.10),
    "dup_lines": ("sqrt(n_dup_lines / (n_lines + 5))", 0.10),
    "repeat_words": ("sqrt(n_repeat_words / (n_words + 50))", 0.10),
}
#: Distances are compared in steps of this fraction of a doubling, feature medians in steps of 1 / GRID.
FINE, GRID = 32, 512


def chi2_cdf(x: float, p: int) -> float:
    """For an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(p // 2))


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks (long), whole texts."""
    p = "__q_"
    out = docs.withColumn(f"{p}text", F.expr(f"btrim(coalesce(cast({text_col} AS string), ''), {SPACES})"))
    out = out.withColumn(f"{p}words", F.expr(f"CASE WHEN {p}text = '' THEN cast(array() AS array<string>) ELSE split({p}text, r'{SPACE}+', -1) END"))
    out = out.withColumns(
        {
            "n_words": F.expr(f"cast(size({p}words) AS bigint)"),
            "word_chars": F.expr(f"cast(length(array_join({p}words, '')) AS bigint)"),
            "n_symbols": F.expr(f"cast(regexp_count({p}text, '[#*$%&|<>]') AS bigint)"),
            "n_upper": F.expr(rf"cast(regexp_count({p}text, r'\p{{Lu}}') AS bigint)"),
            "n_marks": F.expr(f"cast(regexp_count({p}text, '[.,;:!?]') AS bigint)"),
            f"{p}lines": F.expr(f"filter(split(coalesce(cast({text_col} AS string), ''), chr(10), -1), l -> btrim(l, {SPACES}) <> '')"),
            f"{p}hash": F.expr(f"transform({p}words, w -> xxhash64(w))"),
        }
    )
    out = out.withColumns(
        {
            "n_lines": F.expr(f"cast(size({p}lines) AS bigint)"),
            "n_dup_lines": F.expr(f"cast(size({p}lines) - size(array_distinct({p}lines)) AS bigint)"),
            # A window of five words is named by a 64-bit hash of its words' hashes.
            f"{p}windows": F.expr(f"CASE WHEN n_words >= 5 THEN transform(slice({p}hash, 1, size({p}hash) - 4), (x, i) -> xxhash64(x, {p}hash[i + 1], {p}hash[i + 2], {p}hash[i + 3], {p}hash[i + 4])) ELSE cast(array() AS array<bigint>) END"),
        }
    )
    # Starts of windows found twice or more, ascending: equal neighbours in order of (window, start).
    out = out.withColumn(f"{p}order", F.expr(f"CASE WHEN size(array_distinct({p}windows)) < size({p}windows) THEN sort_array(transform({p}windows, (x, i) -> named_struct('x', x, 'i', i))) END"))
    out = out.withColumn(f"{p}starts", F.expr(f"CASE WHEN {p}order IS NOT NULL THEN sort_array(transform(filter({p}order, (o, j) -> (j > 0 AND {p}order[greatest(j - 1, 0)].x = o.x) OR (j + 1 < size({p}order) AND {p}order[least(j + 1, size({p}order) - 1)].x = o.x)), o -> o.i)) END"))
    out = out.withColumn("n_repeat_words", F.expr(f"CASE WHEN {p}starts IS NULL THEN 0L ELSE aggregate({p}starts, named_struct('last', -5, 'n', 0L), (a, s) -> named_struct('last', s, 'n', a.n + least(5, s - a.last)), a -> a.n) END"))
    return out.drop(*[c for c in out.columns if c.startswith(p)])


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def _dot(one: str, two: str) -> str:
    return f"aggregate(zip_with({one}, {two}, (a, b) -> a * b), 0D, (s, v) -> s + v)"


def _distance(x: str, m: str, l: str, p: int) -> Column:
    """The squared Mahalanobis distance: forward substitution with the rows of the Cholesky factor, one after another in ``l``."""
    row = "slice({l}, cast(i * (i + 1) / 2 AS int) + 1, i)".format(l=l)
    y = f"aggregate(sequence(0, {p - 1}), cast(array() AS array<double>), (y, i) -> concat(y, array(({x}[i] - {m}[i] - {_dot(row, 'y')}) / {l}[cast(i * (i + 3) / 2 AS int)])))"
    return F.expr(f"aggregate({y}, 0D, (s, v) -> s + v * v)")


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(2.0**-10)) * FINE).cast("int")


def _sums(p: int) -> dict[str, Column]:
    """What a centre and a covariance need; sums of such sums serve as well."""
    return {"n": F.count("*")} | {f"s{i}": F.sum(F.col("x")[i]) for i in range(p)} | {f"s{i}_{j}": F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(p) for j in range(i + 1)}


def _factor(sums: DataFrame, p: int, floors: list[float], scale: float) -> DataFrame:
    """Centres m and Cholesky factors l, row after row, from sums over a subset; the floors' squares are added to the diagonal."""
    n, cells = F.col("n"), [(i, j) for i in range(p) for j in range(i + 1)]
    value = lambda i, j: (F.col(f"s{i}_{j}") / n - F.col(f"s{i}") / n * F.col(f"s{j}") / n) * scale
    cov = F.array(*[F.greatest(value(i, j), F.lit(0.0)) + floors[i] ** 2 if i == j else value(i, j) for i, j in cells])
    out = sums.select("fit", "size", "hot", F.array(*[F.col(f"s{i}") / n for i in range(p)]).alias("m"), cov.alias("cov"))
    rows, columns, least = (f"array({', '.join(str(v) for v in values)})" for values in ([i for i, _ in cells], [j for _, j in cells], [f"{floors[i] ** 2 / 4!r}D" for i, _ in cells]))
    # Cell after cell: what is left of the covariance, over the diagonal of its column or as the root of itself.
    upto = lambda which: f"slice(l, cast({which}[t] * ({which}[t] + 1) / 2 AS int) + 1, {columns}[t])"
    rest = f"(cov[t] - {_dot(upto(rows), upto(columns))})"
    cell = f"CASE WHEN {rows}[t] = {columns}[t] THEN sqrt(greatest({rest}, {least}[t])) ELSE {rest} / l[cast({columns}[t] * ({columns}[t] + 3) / 2 AS int)] END"
    return out.withColumn("l", F.expr(f"aggregate(sequence(0, {len(cells) - 1}), cast(array() AS array<double>), (l, t) -> concat(l, array({cell})))")).drop("cov")


def _vectors(stats: DataFrame, lang_col: str, source_col: str, features: dict) -> DataFrame:
    """``stats`` with the group's name __q_g, the language's and the vector."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("\x00"))
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\x00"))
    return stats.withColumns({"__q_g": F.concat_ws("|", lang, source), "__q_lang": lang, "__q_x": F.array(*[F.expr(sql).cast("double") for sql, _ in features.values()])})


def _with_fit(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """``rows`` with their fit's columns: hot fits, HOT_KEYS at most, by broadcast, the others by an ordinary join."""
    hot = rows.filter("hot").join(F.broadcast(fit.filter("hot").drop("hot", "size")), "fit")
    return hot.unionByName(rows.filter("NOT hot").join(fit.filter("NOT hot").drop("hot", "size"), "fit"))


def _medians(rows: DataFrame, vector: Column) -> DataFrame:
    """(fit, size, hot, mids): for each fit the median of every component, on the grid. Bins merge before the shuffle."""
    bins = F.transform(vector, lambda v: F.floor(v * GRID).cast("int"))
    counts = rows.select("fit", "size", "hot", F.posexplode(bins).alias("i", "b")).groupBy("fit", "size", "hot", "i", "b").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("fit", "size", "hot", "i").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    mids = counts.withColumn("upto", upto).filter("upto >= 0.5 * size").groupBy("fit", "size", "hot", "i").agg((F.min("b") / GRID).alias("mid"))
    return mids.groupBy("fit", "size", "hot").agg(F.array_sort(F.collect_list(F.struct("i", "mid"))).alias("mids")).withColumn("mids", F.col("mids.mid"))


def estimates(vectors: DataFrame, features: dict, min_group: int = MIN_GROUP, h: float = H) -> DataFrame:
    """A row a group: __q_g, its rows __q_rows, the pool's size __q_size and robust centre __q_m and Cholesky factor __q_l.

    ``vectors`` is read a few times. Every step is one small plan over narrow rows: squared distances are counted and summed
    in bins, so that the sums over the nearest share h come from the same pass as the share itself.
    """
    p, floors = len(features), [x[1] for x in features.values()]
    if p % 2:
        raise ValueError("an even number of features is needed")
    named = vectors.select(F.col("__q_g").alias("g"), F.col("__q_lang").alias("g_lang"), F.col("__q_x").alias("x"))

    sizes = named.groupBy("g", "g_lang").agg(F.count("*").alias("rows"))
    by_lang = sizes.filter(F.col("rows") < min_group).groupBy("g_lang").agg(F.sum("rows").alias("lang_size"))
    fits = sizes.join(by_lang, "g_lang", "left").select("g", "rows", F.when(F.col("rows") >= min_group, F.concat(F.lit("g|"), "g")).when(F.col("lang_size") >= min_group, F.concat(F.lit("l|"), "g_lang")).otherwise("all").alias("fit"))
    fits = written(fits, "q-fits")
    pools = fits.groupBy("fit").agg(F.sum("rows").alias("size"))
    hot = hot_keys(pools, ["fit"], "size").select("fit", F.lit(True).alias("hot"))
    fits = written(fits.join(pools, "fit").join(F.broadcast(hot), "fit", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), "q-pools")
    rows = written(join_per_key(named, fits, ["g"], "rows").select("fit", "size", "hot", "x"), "q-rows")

    # Start: medians and MADs on a grid.
    centre = written(_medians(rows, F.col("x")).withColumnRenamed("mids", "m"), "q-median")
    spread = _medians(_with_fit(rows, centre), F.expr("zip_with(x, m, (v, c) -> abs(v - c))"))
    diagonal = F.array(*[F.greatest(F.col("mids")[i] * 1.4826, F.lit(floors[i])) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)])
    fit = written(centre.join(spread.select("fit", diagonal.alias("l")), "fit"), "q-start")

    inner = chi2_quantile(h, p)
    for _ in range(STEPS):
        at = _with_fit(rows, fit).withColumn("b", _bin(_distance("x", "m", "l", p)))
        binned = at.groupBy("fit", "size", "hot", "b").agg(*[c.alias(k) for k, c in _sums(p).items()])
        before = F.sum("n").over(Window.partitionBy("fit", "size", "hot").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        nearest = binned.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < F.lit(h) * F.col("size"))
        fit = written(_factor(nearest.groupBy("fit", "size", "hot").agg(*[F.sum(k).alias(k) for k in _sums(p)]), p, floors, h / chi2_cdf(inner, p + 2)), "q-fit")
    # Reweighting: all rows within the usual quantile.
    edge = chi2_quantile(0.975, p)
    near = _with_fit(rows, fit).filter(_distance("x", "m", "l", p) <= edge)
    fit = written(_factor(near.groupBy("fit", "size", "hot").agg(*[c.alias(k) for k, c in _sums(p).items()]), p, floors, 0.975 / chi2_cdf(edge, p + 2)), "q-fit")
    groups = fits.select("g", "rows", "fit").join(fit.drop("hot"), "fit").drop("fit")
    return written(groups.select(*[F.col(a).alias(f"__q_{a}") for a in ("g", "rows", "size", "m", "l")]), "q-groups")


def _verdict(at: DataFrame, features: dict | None, min_group: int, cutoff: float) -> DataFrame:
    p = len(features or FEATURES)
    out = at.withColumn("d2", _distance("__q_x", "__q_m", "__q_l", p)).withColumn("kept", ~F.col("base_failed") & ~((F.col("__q_size") >= min_group) & (F.col("d2") > chi2_quantile(cutoff, p))))
    return out.drop(*[c for c in out.columns if c.startswith("__q_")])


def judged_rows(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", features: dict | None = None, min_group: int = MIN_GROUP, h: float = H, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` with the statistics, base_failed, d2 and kept, which take the place of columns so named; all others stay,
    unless they begin with __q_. Texts are written once beside their statistics and joined with the groups' estimates,
    whose size the optimizer knows: by broadcast if it is small, else by shuffles that split hot groups."""
    features = features or FEATURES
    stats = written(_vectors(statistics(docs, text_col).withColumn("base_failed", base_failed()), lang_col, source_col, features), "q-docs")
    groups = estimates(stats, features, min_group, h)
    return _verdict(stats.join(groups, "__q_g"), features, min_group, cutoff)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", features: dict | None = None, min_group: int = MIN_GROUP, h: float = H, cutoff: float = CUTOFF) -> DataFrame:
    """One row a document: doc_id, lang, source, the statistics, base_failed, d2, kept. Rules and estimate see every document."""
    features = features or FEATURES
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    stats = written(_vectors(statistics(rows).drop("text").withColumn("base_failed", base_failed()), "lang", "source", features), "q-stats")
    groups = estimates(stats, features, min_group, h)
    return _verdict(join_per_key(stats, groups, ["__q_g"], "__q_rows"), features, min_group, cutoff)
