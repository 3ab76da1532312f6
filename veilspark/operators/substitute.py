"""Rewriting texts by a mapping, both ways, with counts; and where its terms stand.

Where terms stand is found by ``terms``: a broadcast index of the confirmed entries that walks over each text once, or shards
of it for very large mappings. Rewriting then folds over the entries that a text meets, the longest first: those that stand
in it, and those that only a replacement makes. What is left out could not have changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import apart
from ..storage import written
from . import terms

_PAIRS = terms.PAIRS
_ORDER = "(a, b) -> CASE WHEN a.l <> b.l THEN b.l - a.l WHEN a.p.o < b.p.o THEN -1 WHEN a.p.o > b.p.o THEN 1 WHEN a.p.n < b.p.n THEN -1 WHEN a.p.n > b.p.n THEN 1 ELSE 0 END"


def _entries(mapping: DataFrame, search: str, put: str, new: str = "e.n") -> DataFrame:
    """(o, n, r): what is looked for, what belongs to it, and what it becomes."""
    pair = F.struct(F.col(search).alias("o"), F.col(put).alias("n"))
    return mapping.filter("confirmed").filter((F.length(search) > 0) & F.col(put).isNotNull()).select(pair.alias("e")).select("e.o", "e.n", F.expr(new).alias("r"))


def with_pairs(docs: DataFrame, mapping: DataFrame, search: str, put: str, text_col: str, new: str = "e.n") -> DataFrame:
    """``docs`` with __pairs: the entries that replacing all in turn meets, longest first; ``new`` tells what an entry ``e`` puts
    in its place."""
    entries = _entries(mapping, search, put, new)
    data = terms.one_shard(entries)
    if data:
        return docs.withColumn("__pairs", terms.pairs(data, F.col(text_col)))
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "sub-docs")
    find = lambda texts: terms.places_of(texts, entries, "__row", "__t").select("__row", "x.o", "x.n").distinct()
    found = written(find(keyed.select("__row", F.col(text_col).alias("__t"))), "sub-found")
    while True:
        # As many rows of an entry as the mapping has.
        listed = found.join(entries.groupBy("o", "n").agg(F.count("*").alias("times")), ["o", "n"]).withColumn("__", F.explode(F.expr("sequence(1, times)")))
        pairs = listed.groupBy("__row").agg(F.expr(f"transform(array_sort(collect_list(struct(octet_length(o) AS l, struct(o, n) AS p)), {_ORDER}), x -> x.p)").alias("__pairs"))
        out = keyed.join(pairs, "__row", "left").withColumn("__pairs", F.coalesce("__pairs", F.expr(f"cast(array() AS {_PAIRS})")))
        passed = f"aggregate(__pairs, array({text_col}), (a, e) -> CASE WHEN contains(element_at(a, -1), e.o) THEN concat(a, array(replace(element_at(a, -1), e.o, {new}))) ELSE a END)"
        texts = out.filter("size(__pairs) > 0").select("__row", F.explode(F.expr(passed)).alias("__t"))
        more = written(find(texts).join(found, ["__row", "o", "n"], "left_anti"), "sub-more")
        if not more.limit(1).count():
            return out.drop("__row")
        found = written(found.unionByName(more), "sub-found")


def with_places(docs: DataFrame, mapping: DataFrame, search: str, put: str, text: str) -> DataFrame:
    """``docs`` with __places: where entries stand in ``text`` (an expression), by place."""
    entries = _entries(mapping, search, put)
    data = terms.one_shard(entries)
    if data:
        return docs.withColumn("__places", terms.places(data, F.expr(text)))
    keyed = written(docs.withColumn("__row", F.monotonically_increasing_id()), "sub-docs")
    found = terms.places_of(keyed.select("__row", F.expr(text).alias("__t")), entries, "__row", "__t")
    listed = found.groupBy("__row").agg(F.sort_array(F.collect_list("x")).alias("__places"))
    return keyed.join(listed, "__row", "left").withColumn("__places", F.coalesce("__places", F.expr(f"cast(array() AS {terms.PLACES})"))).drop("__row")


def _fold(text: str, count: str, put: str) -> str:
    state = f"named_struct('t', {text}, 'n', 0)"
    return f"aggregate(coalesce(__pairs, cast(array() AS {_PAIRS})), {state}, (a, e) -> CASE WHEN contains(a.t, e.o) THEN element_at(transform(array(replace(a.t, e.o, {put})), r -> named_struct('t', r, 'n', a.n + {count})), 1) ELSE a END)"


def _times(text: str, term: str) -> str:
    return f"CASE WHEN length({term}) > 0 THEN cast((length({text}) - length(replace({text}, {term}, ''))) / length({term}) AS int) ELSE 0 END"


def _done(rows: DataFrame, fold: str, text_col: str, columns: list[str]) -> DataFrame:
    out = rows.withColumn("__out", F.expr(f"CASE WHEN {text_col} IS NOT NULL THEN {fold} END"))
    return out.select(*[F.col("__out.t").alias(c) if c == text_col else F.col(c) for c in columns if c != "replacements_made"], F.coalesce("__out.n", F.lit(0)).alias("replacements_made"))


def encode(docs: DataFrame, mapping: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """Originals replaced by surrogates, literally and one entry after the other, and replacements_made: for each entry
    that changed the text, how often its surrogate stands there afterwards (``strict``: how often its original stood
    there before). Null text stays null."""
    count = _times("a.t", "e.o") if strict else f"CASE WHEN r <> a.t THEN {_times('r', 'e.n')} ELSE 0 END"
    return _done(with_pairs(docs, mapping, "original", "surrogate", text_col, new="e.n"), _fold(text_col, count, "e.n"), text_col, docs.columns)


def decode(docs: DataFrame, mapping: DataFrame, text_col: str = "text", strict: bool = False) -> DataFrame:
    """Surrogates replaced by originals; counts those that stood there. Unless ``strict``, an original is read as a template:
    ``$name`` and ``${name}`` give nothing, ``$0`` the surrogate and ``$$`` a dollar."""
    put = "e.n"
    if not strict:
        put = r"replace(regexp_replace(regexp_replace(replace(e.n, '$$', chr(1)), r'\$\{0\}|\$0(?![A-Za-z0-9_])', chr(2)), r'\$\{[^}]*\}|\$[A-Za-z0-9_]+', ''), chr(1), '$')"
        put = f"replace({put}, chr(2), e.o)"
    return _done(with_pairs(docs, mapping, "surrogate", "original", text_col, new=put), _fold(text_col, _times("a.t", "e.o"), put), text_col, docs.columns)


def preview(docs: DataFrame, mapping: DataFrame, mode: str = "encode", text_col: str = "text") -> DataFrame:
    """``docs`` with spans: every place (bytes) of every confirmed term, overlapping ones too, by start then end."""
    search, put = ("original", "surrogate") if mode == "encode" else ("surrogate", "original")
    rows = with_places(docs, mapping, search, put, text_col)
    spans = "array_sort(transform(filter(__places, x -> x.k), x -> named_struct('start', x.s, 'end', x.e, 'term', x.o, 'replacement', x.n)))"
    return rows.withColumn("spans", F.expr(f"CASE WHEN {text_col} IS NOT NULL THEN {spans} END")).select(*[c for c in docs.columns if c != "spans"], "spans")


def highlight(docs: DataFrame, mapping: DataFrame, mode: str = "encode", text_col: str = "text") -> DataFrame:
    """``docs`` with spans (characters): terms in any case, the longest first, none overlapping."""
    search, put = ("original", "surrogate") if mode == "encode" else ("surrogate", "original")
    rows = with_places(docs, mapping.withColumn(search, F.lower(search)), search, put, f"lower({text_col})")
    order = "CASE WHEN l.b <> r.b THEN r.b - l.b WHEN l.o < r.o THEN -1 WHEN l.o > r.o THEN 1 ELSE l.s - r.s END"
    marks = "transform(__places, x -> named_struct('s', x.cs, 'e', x.ce, 'b', x.e - x.s, 'o', x.o))"
    spans = f"transform({apart(marks, 'struct<s: int, e: int, b: int, o: string>', order)}, x -> named_struct('start', x.s, 'end', x.e, 'term', x.o))"
    return rows.withColumn("spans", F.expr(f"CASE WHEN {text_col} IS NOT NULL THEN {spans} END")).select(*[c for c in docs.columns if c != "spans"], "spans")
