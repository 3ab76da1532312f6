"""Mentions to entities, within each document: grouping, span blocking, merging, conflict resolution, scores.

All steps are folds over arrays of one row, so nothing is shuffled whatever the corpus' size. Where the order of
candidates matters, it is total: pass, rule, place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..functions.spans import apart, before, disjoint, groups, let
from .extract import MENTION, NO_MENTIONS, mentions_sql, of_gates
from .rules import Passes

SPANS = "array<struct<s: int, e: int>>"
FEATURES = "map<string, string>"
NO_FEATURES = f"cast(map() AS {FEATURES})"
#: A candidate: pass, category, text, confidence, source, occurrences, spans in bytes, whether it needs a review, features.
CANDIDATE = f"struct<p: int, cat: string, t: string, conf: double, src: string, occ: int, offs: {SPANS}, review: boolean, feats: {FEATURES}>"
ENTITY = f"struct<text: string, category: string, confidence: double, occurrences: int, offsets: array<struct<start: int, end: int>>, detection_source: string, needs_review: boolean, features: map<string, string>>"


def rank(source: str) -> str:
    return "CASE " + " ".join(f"WHEN {source} = '{s}' THEN {r}" for s, r in lexicon.SOURCE_RANKS.items()) + " ELSE 0 END"


def stronger(left: str, right: str) -> str:
    """The source of higher rank, the left one of equals."""
    return f"CASE WHEN {rank(right)} > {rank(left)} THEN {right} ELSE {left} END"


def absent_added(features: str, more: str) -> str:
    """SQL: features with those of ``more`` whose keys aren't there."""
    return f"CASE WHEN cardinality({more}) = 0 THEN {features} ELSE map_concat({features}, map_filter({more}, (__key, __value) -> NOT map_contains_key({features}, __key))) END"


def contained(inner: str, outer: str) -> str:
    return f"{inner}.s >= {outer}.s AND {inner}.e <= {outer}.e"


def without_overlaps(spans: str, kind: str = MENTION) -> str:
    """SQL: the longest first, then the earliest, each kept unless it overlaps a kept one; by place."""
    return apart(spans, kind, "CASE WHEN l.e - l.s > r.e - r.s THEN -1 WHEN l.e - l.s < r.e - r.s THEN 1 WHEN l.s < r.s THEN -1 WHEN l.s > r.s THEN 1 ELSE 0 END")


def face(t: str, person: str = "true") -> str:
    """What comparing an entity's text needs: key and title for persons only."""
    return f"named_struct('t', {t}, 'norm', {text.normalized(t)}, 'ident', CASE WHEN {person} THEN {text.identity(t)} ELSE '' END, 'low', lower({t}), 'titled', {person} AND {text.titled(t)})"


def chosen(a: str, b: str) -> str:
    """Of two faces of one person: the longer key, then the one without title, then the longer text, then the first."""
    return (
        f"CASE WHEN octet_length({a}.ident) > octet_length({b}.ident) THEN {a} WHEN octet_length({b}.ident) > octet_length({a}.ident) THEN {b} "
        f"WHEN {a}.titled AND NOT {b}.titled THEN {b} WHEN {b}.titled AND NOT {a}.titled THEN {a} WHEN octet_length({b}.t) > octet_length({a}.t) THEN {b} ELSE {a} END"
    )


def group_sql(mentions: str, number: int) -> str:
    """SQL: candidates of one pass from its keyed mentions (array of (k, x))."""
    # Sorted by key, cut where it changes, and the groups put in the order of their first mentions: no search a key.
    numbered = f"array_sort(transform({mentions}, (y, i) -> named_struct('k', y.k, 'i', i, 'x', y.x)), (l, r) -> CASE WHEN l.k < r.k THEN -1 WHEN l.k > r.k THEN 1 ELSE l.i - r.i END)"
    keyed = f"transform(array_sort({let('__n', numbered, groups('__n', 'k'))}, (l, r) -> get(l, 0).i - get(r, 0).i), g -> transform(g, y -> y.x))"
    first = "g[0]"
    t = f"{first}.t"
    if number == 10:
        t = f"aggregate(slice(g, 2, greatest(size(g) - 1, 0)), {face(first + '.t')}, (acc, x) -> {let('f', face('x.t'), chosen('acc', 'f'))}, acc -> acc.t)"
    conf = "array_max(transform(g, x -> x.conf))" if number in (4, 5, 10) else f"{first}.conf"
    source = f"array_max(transform(g, x -> named_struct('r', {rank('x.src')}, 's', x.src))).s" if number == 10 else f"{first}.src"
    offsets = "transform(g, x -> named_struct('s', x.s, 'e', x.e))"
    if number == 5:
        offsets = f"array_sort(array_distinct({offsets}))"
    feats = "map('date_kind', CASE WHEN exists(g, x -> x.conf >= 0.93D) THEN 'geburtsdatum' ELSE 'datum' END)" if number == 4 else NO_FEATURES
    category = "CASE g[0].rule DIV 10 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in ((1, "email"), (2, "iban"), (3, "betrag"), (4, "datum"), (5, "telefon"), (6, "ort"), (7, "ort"), (8, "firma"), (10, "person"), (11, "produkt"), (12, "sonstiges"))) + " END"
    return f"transform({keyed}, g -> named_struct('p', {number}, 'cat', {category}, 't', {t}, 'conf', {conf}, 'src', {source}, 'occ', size({offsets}), 'offs', {offsets}, 'review', false, 'feats', {feats}))"


_KEYS = {7: "lower(x.t)", 10: text.identity("x.t"), 6: "concat(CASE WHEN x.rule = 63 THEN 'block' WHEN x.rule = 62 THEN 'postcode' ELSE 'street' END, ':', x.t)"}


def address_sql(streets: str, towns: str, text_col: str = "text") -> str:
    """SQL: address mentions: a street and a town on the next line make a block; what lies in one isn't told again."""
    # Towns by line as spans from their line on, so that a street finds those of the next line by binary search.
    by_line = f"array_sort(transform({towns}, x -> named_struct('s', x.ln, 'e', x.ln, 'x', x)), (l, r) -> CASE WHEN l.s <> r.s THEN l.s - r.s ELSE l.x.s - r.x.s END)"
    ordered = f"array_sort({streets}, (l, r) -> CASE WHEN l.ln <> r.ln THEN l.ln - r.ln WHEN l.rule <> r.rule THEN l.rule - r.rule ELSE l.s - r.s END)"
    block = f"named_struct('t', cast(substring(__bin, a.s + 1, b.x.e - a.s) AS string), 's', a.s, 'e', b.x.e, 'cs', a.cs, 'ce', b.x.ce, 'rule', 63, 'conf', 0.88D, 'src', 'parser', 'ln', a.ln)"
    below = let("__p", before("tt", "a.ln + 1"), f"slice(tt, __p + 1, {before('tt', 'a.ln + 2')} - __p)")
    apart_from = lambda rows: f"filter({rows}, m -> NOT exists(bb, b -> {contained('m', 'b')}))"
    body = let("tt", by_line, let("ss", ordered, let("bb", f"flatten(transform(ss, a -> transform({below}, b -> {block})))", f"concat(bb, {apart_from('ss')}, {apart_from('transform(tt, a -> a.x)')})")))
    # Bytes are cut out at once, where characters would be counted from the text's beginning.
    return f"CASE WHEN size({streets}) + size({towns}) > 0 THEN {let('__bin', f'cast({text_col} AS binary)', body)} ELSE {NO_MENTIONS} END"


def block_sql(candidates: str) -> str:
    """SQL: candidates in order, each without the spans that overlap an earlier one's that stayed; those left without any go."""
    spans = f"flatten(transform({candidates}, (c, i) -> transform(c.offs, (o, j) -> named_struct('s', o.s, 'e', o.e, 'i', i, 'j', j))))"
    order = "CASE WHEN l.i <> r.i THEN l.i - r.i ELSE l.j - r.j END"
    kept = f"array_sort({apart(spans, 'struct<s: int, e: int, i: int, j: int>', order, '__k.i <> __y.i')}, (l, r) -> {order})"
    one = lambda offsets: f"named_struct('p', c.p, 'cat', c.cat, 't', c.t, 'conf', c.conf, 'src', c.src, 'occ', size({offsets}), 'offs', {offsets}, 'review', c.review, 'feats', c.feats)"
    some = let("c", f"get({candidates}, get(g, 0).i)", let("o", "transform(g, o -> named_struct('s', o.s, 'e', o.e))", one("o")))
    made = let("kk", kept, f"transform({groups('kk', 'i')}, g -> {some})")
    # Where no spans overlap, all stay.
    whole = f"transform(filter({candidates}, c -> size(c.offs) > 0), c -> {one('c.offs')})"
    return f"CASE WHEN size({candidates}) = 0 THEN {candidates} WHEN {disjoint(candidates)} THEN {whole} ELSE {made} END"


#: A candidate while entities are merged: with its face.
_FACED = f"struct<f: struct<t: string, norm: string, ident: string, low: string, titled: boolean>, cat: string, conf: double, src: string, occ: int, offs: {SPANS}, review: boolean, feats: {FEATURES}>"


def merge_sql(candidates: str) -> str:
    """SQL: candidates by length, each merged into the first that it equals, or that is the same person, or that holds it as
    whole words within its category; then without spans inside earlier ones'; by occurrences."""
    order = "CASE WHEN octet_length(l.t) <> octet_length(r.t) THEN octet_length(r.t) - octet_length(l.t) ELSE l.i - r.i END"
    numbered = f"transform({candidates}, (c, i) -> named_struct('t', c.t, 'i', i, 'c', c))"
    faced = f"transform(array_sort({numbered}, (l, r) -> {order}), n -> named_struct('f', {face('n.t', 'n.c.cat = ' + chr(39) + 'person' + chr(39))}, 'cat', n.c.cat, 'conf', n.c.conf, 'src', n.c.src, 'occ', n.c.occ, 'offs', n.c.offs, 'review', n.c.review, 'feats', n.c.feats))"
    at = "locate(c.f.low, e.f.low)"
    edge = f"({at} = 1 OR NOT substring(e.f.low, {at} - 1, 1) rlike {text.quoted(text.ALNUM)}) AND NOT substring(e.f.low, {at} + length(c.f.low), 1) rlike {text.quoted(text.ALNUM)}"
    same = f"e.f.norm = c.f.norm OR (e.cat = 'person' AND c.cat = 'person' AND e.f.ident <> '' AND e.f.ident = c.f.ident) OR (e.cat = c.cat AND octet_length(c.f.t) >= 3 AND {at} > 0 AND {edge})"
    joined = f"named_struct('f', CASE WHEN e.cat = 'person' AND c.cat = 'person' THEN {chosen('e.f', 'c.f')} ELSE e.f END, 'cat', e.cat, 'conf', greatest(e.conf, c.conf), 'src', {stronger('e.src', 'c.src')}, 'occ', e.occ + c.occ, 'offs', concat(e.offs, c.offs), 'review', e.review OR c.review, 'feats', {absent_added('e.feats', 'c.feats')})"
    step = let("hit", f"array_position(transform(acc, e -> {same}), true)", f"CASE WHEN hit = 0 THEN concat(acc, array(c)) ELSE transform(acc, (e, i) -> CASE WHEN i = hit - 1 THEN {joined} ELSE e END) END")
    # Most documents have nothing to merge: the fold, which copies its state at each element, is for the others.
    any_same = f"exists(sequence(1, size(__n) - 1), __i -> {let('c', 'get(__n, __i)', f'exists(slice(__n, 1, __i), e -> {same})')})"
    merged = let("__n", faced, f"CASE WHEN size(__n) < 2 OR NOT {any_same} THEN cast(__n AS array<{_FACED}>) ELSE aggregate(__n, cast(array() AS array<{_FACED}>), (acc, c) -> {step}) END")
    keep = "named_struct('f', c.f, 'cat', c.cat, 'conf', c.conf, 'src', c.src, 'occ', c.occ, 'offs', kept, 'review', c.review, 'feats', c.feats)"
    prune = let("kept", f"filter(c.offs, o -> NOT exists(a.used, u -> {contained('o', 'u')}))", f"CASE WHEN size(kept) = 0 THEN a ELSE named_struct('used', concat(a.used, kept), 'out', concat(a.out, array({keep}))) END")
    # Where no spans overlap, none lies in another.
    pruned = f"aggregate(__g, named_struct('used', cast(array() AS {SPANS}), 'out', cast(array() AS array<{_FACED}>)), (a, c) -> {prune}, a -> a.out)"
    pruned = let("__g", merged, f"CASE WHEN {disjoint('__g')} THEN filter(__g, c -> size(c.offs) > 0) ELSE {pruned} END")
    by_count = f"array_sort(transform({pruned}, (c, i) -> named_struct('c', c, 'i', i)), (l, r) -> CASE WHEN l.c.occ <> r.c.occ THEN r.c.occ - l.c.occ ELSE l.i - r.i END)"
    return f"transform({by_count}, x -> x.c)"


def resolve_sql(entities: str) -> str:
    """SQL: of overlapping spans the one of higher category priority stays, then the longer, then the surer; recounted."""
    priority = "CASE " + " ".join(f"WHEN c.cat = '{c}' THEN {p}" for c, p in lexicon.PRIORITIES.items()) + " ELSE 0 END"
    picks = f"flatten(transform({entities}, (c, i) -> transform(c.offs, (o, j) -> named_struct('s', o.s, 'e', o.e, 'p', {priority}, 'conf', c.conf, 'i', i, 'j', j))))"
    order = "CASE WHEN l.p <> r.p THEN r.p - l.p WHEN l.e - l.s <> r.e - r.s THEN (r.e - r.s) - (l.e - l.s) WHEN l.conf > r.conf THEN -1 WHEN l.conf < r.conf THEN 1 WHEN l.i <> r.i THEN l.i - r.i ELSE l.j - r.j END"
    pick = "struct<s: int, e: int, p: int, conf: double, i: int, j: int>"
    by_entity = f"array_sort({apart(picks, pick, order)}, (l, r) -> CASE WHEN l.i <> r.i THEN l.i - r.i ELSE l.j - r.j END)"
    some = let("kk", by_entity, f"transform({groups('kk', 'i')}, g -> named_struct('c', get({entities}, get(g, 0).i), 'offs', transform(g, k -> named_struct('s', k.s, 'e', k.e))))")
    # Where no spans overlap, all stay.
    return f"CASE WHEN {disjoint(entities)} THEN transform(filter({entities}, c -> size(c.offs) > 0), c -> named_struct('c', c, 'offs', c.offs)) ELSE {some} END"


def score_sql(resolved: str) -> str:
    """SQL: entities with needs_review and its reason (unless they have one), by the first rule that applies."""
    c = "x.c"
    ner = f"{c}.src = 'ner' AND {c}.cat = 'person'"
    reason = (
        f"CASE WHEN {c}.cat IN ('email', 'iban', 'telefon') AND {c}.conf >= 0.75D THEN NULL WHEN {ner} AND {c}.conf >= 0.88D THEN NULL "
        f"WHEN {ner} AND {c}.conf < 0.72D THEN 'ner_low_confidence' WHEN {c}.conf >= 0.90D THEN NULL "
        f"WHEN {c}.cat = 'person' AND {c}.conf < 0.85D THEN 'person_mid_confidence' WHEN {c}.conf < 0.85D THEN 'below_threshold' END"
    )
    # Between 0.85 and 0.90 no rule applies, and what the merged candidates said stays.
    safe = f"({c}.cat IN ('email', 'iban', 'telefon') AND {c}.conf >= 0.75D) OR ({ner} AND {c}.conf >= 0.88D) OR {c}.conf >= 0.90D"
    review = f"CASE WHEN {reason} IS NOT NULL THEN true WHEN {safe} THEN false ELSE {c}.review END"
    features = f"CASE WHEN {reason} IS NULL THEN {c}.feats ELSE {absent_added(f'{c}.feats', f'map({chr(39)}review_reason{chr(39)}, {reason})')} END"
    entity = f"named_struct('text', {c}.f.t, 'category', {c}.cat, 'confidence', {c}.conf, 'occurrences', size(x.offs), 'offsets', transform(x.offs, o -> named_struct('start', o.s, 'end', o.e)), 'detection_source', {c}.src, 'needs_review', {review}, 'features', {features})"
    return f"transform({resolved}, x -> {entity})"


def candidates(docs: DataFrame, passes: Passes | None = None, text_col: str = "text", ner_col: str | None = None) -> DataFrame:
    """``docs`` with __all: the candidates of all passes in order, before blocking. ``ner_col``: an array of candidates of a
    token-classification model; its persons go before the rules' persons, the others before those."""
    passes = passes or Passes()
    out = docs.withColumn("text" if text_col == "text" else "__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    src = "text" if text_col == "text" else "__text"
    out = out.withColumns({f"__{name}": F.expr(sql) for name, sql in of_gates(src).items() if name != "text"})
    # A step's columns are made together: each step is one analysis of a large expression, not one a pass.
    sources = lambda rules: "concat(" + ", ".join([NO_MENTIONS, *(mentions_sql(r, src, made=True) for r in rules)]) + ")"
    numbers = passes.numbers()
    found = {f"__m{n}": sources(passes.of(n)) for n in numbers if n != 6}
    if 6 in numbers:
        found |= {"__s": sources(r for r in passes.of(6) if r.number < 62), "__p": sources(r for r in passes.of(6) if r.number == 62)}
    out = out.withColumns({name: F.expr(sql) for name, sql in found.items()}).drop("__low", "__digits")
    mentions = {n: f"__m{n}" for n in numbers} | ({4: without_overlaps("__m4")} if 4 in numbers else {}) | ({6: address_sql("__s", "__p", src)} if 6 in numbers else {})
    out = out.withColumns({f"__k{n}": F.expr(f"transform({sql}, x -> named_struct('k', {_KEYS.get(n, 'x.t')}, 'x', x))") for n, sql in mentions.items()}).drop(*found)
    out = out.withColumns({f"__c{n}": F.expr(f"CASE WHEN size(__k{n}) = 0 THEN cast(array() AS array<{CANDIDATE}>) ELSE cast({group_sql(f'__k{n}', n)} AS array<{CANDIDATE}>) END") for n in numbers}).drop(*[f"__k{n}" for n in numbers])
    order = []
    for n in sorted({*passes.numbers(), *((9, 10) if ner_col else ())}):
        if ner_col and n == 9:
            order.append(f"filter({ner_col}, c -> c.cat <> 'person')")
        if ner_col and n == 10:
            order.append(f"filter({ner_col}, c -> c.cat = 'person')")
        if n in passes.numbers():
            order.append(f"__c{n}")
    # The row number's test is always true, as in ``detect``: an explode of what is found would have all of it computed again,
    # as a filter and for each field.
    found = f"concat(cast(array() AS array<{CANDIDATE}>), {', '.join(order)})"
    out = out.withColumn("__all", F.expr(f"CASE WHEN monotonically_increasing_id() < 0 THEN cast(array() AS array<{CANDIDATE}>) ELSE {found} END"))
    return out.drop(*[f"__c{n}" for n in passes.numbers()])


def detect(docs: DataFrame, passes: Passes | None = None, text_col: str = "text", ner_col: str | None = None) -> DataFrame:
    """``docs`` with ``entities``: array of ENTITY. Null text has none."""
    found = candidates(docs, passes, text_col, ner_col)
    # Each step is a column of its own, so none is evaluated twice; most documents stop at the first.
    found = found.withColumn("__b", F.expr(block_sql("__all"))).withColumn("__d", F.expr(merge_sql("__b")))
    # The row number's test is always true. It keeps the optimizer from copying the whole computation into filters and
    # field accesses above: expressions with such a number are evaluated once, where they stand.
    made = f"CASE WHEN monotonically_increasing_id() < 0 OR size(__all) = 0 THEN cast(array() AS array<{ENTITY}>) ELSE cast({score_sql('__r')} AS array<{ENTITY}>) END"
    found = found.withColumn("__r", F.expr(resolve_sql("__d"))).withColumn("entities", F.expr(made))
    return found.select(*[c for c in docs.columns if c != "entities"], "entities")


def entity_rows(detected: DataFrame, *ids: str) -> DataFrame:
    """A row an entity: ids, its fields, date_kind and review_reason, offsets as text (start-end, comma-joined)."""
    rows = detected.select(*ids, F.explode("entities").alias("x"))
    offsets = F.array_join(F.transform("x.offsets", lambda o: F.concat_ws("-", o["start"].cast("string"), o["end"].cast("string"))), ",")
    return rows.select(*ids, F.col("x.text").alias("entity"), F.col("x.category").alias("category"), F.col("x.confidence").alias("confidence"), F.col("x.occurrences").alias("occurrences"), F.col("x.detection_source").alias("detection_source"), F.col("x.needs_review").alias("needs_review"), F.element_at("x.features", "date_kind").alias("date_kind"), F.element_at("x.features", "review_reason").alias("review_reason"), offsets.alias("offsets"))
