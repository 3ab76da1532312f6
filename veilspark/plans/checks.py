"""Queries that hold single steps of resolution, scoring, files and substitution against SQL, over spans, confidences and notes
drawn from whole tables, so that both outcomes of each test occur."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import mapping as m
from ..operators import ner, resolve, review, substitute
from ..operators.extract import extract
from ..operators.rules import Passes, rules
from ..sources import documents as files
from ..storage import new_folder
from .pipeline import accepted, spread
from .queries import _EMAILS, _FIRST, _SPARK_FIRST, _email_map, customer_notes, query, table

_PASSES = Passes()
_CATS = [c for c, *_ in lexicon.CATEGORIES]
_SOURCES = list(lexicon.SOURCE_RANKS)
_LIST = lambda values: ", ".join(f"'{v}'" for v in values)

# A span, category and confidence of every line item, in both dialects.
_S, _E, _CONF = "l_partkey % 120", "l_partkey % 120 + l_suppkey % 29 + 1", "cast(55 + (l_partkey * 7 + l_linenumber * 13) % 45 AS double) / 100"
_CAT = f"array({_LIST(_CATS)})[cast(l_suppkey % {len(_CATS)} AS int)]"
_CAT_SQL = f"[{_LIST(_CATS)}][l_suppkey % {len(_CATS)} + 1]"
_SRC = f"array({_LIST(_SOURCES)})[cast(l_partkey % {len(_SOURCES)} AS int)]"
_SRC_SQL = f"[{_LIST(_SOURCES)}][l_partkey % {len(_SOURCES)} + 1]"
_FACE = "named_struct('t', concat('e', l_linenumber), 'norm', '', 'ident', '', 'low', '', 'titled', false)"
_PRIORITY = "CASE cat " + " ".join(f"WHEN '{c}' THEN {p}" for c, p in lexicon.PRIORITIES.items()) + " ELSE 0 END"
#: Greedy choice in SQL: of a list of one-element lists each is added unless it overlaps one that is there.
_GREEDY = "list_reduce(list_prepend([], {}), lambda a, x: CASE WHEN len(list_filter(a, lambda k: x[1].s < k.e AND x[1].e > k.s)) > 0 THEN a ELSE list_concat(a, x) END)"


def _lines(spark, sf_dir, offsets: str):
    """(l_orderkey, cc): the line items of an order as merged entities, in their order."""
    entity = f"named_struct('f', {_FACE}, 'cat', {_CAT}, 'conf', {_CONF}, 'src', {_SRC}, 'occ', 1, 'offs', {offsets}, 'review', false, 'feats', cast(map() AS map<string, string>))"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.expr(f"{_S} AS s"), F.expr(f"{_E} AS e"), F.expr(entity).alias("c")).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.expr("array_sort(collect_list(x), (l, r) -> cast(CASE WHEN l.l_linenumber <> r.l_linenumber THEN l.l_linenumber - r.l_linenumber WHEN l.s <> r.s THEN l.s - r.s ELSE l.e - r.e END AS int))").alias("x")).select("l_orderkey", F.transform("x", lambda y: y["c"]).alias("cc"))


@query(
    f"WITH c AS (SELECT l_orderkey, l_linenumber AS i, {_S} AS s, {_E} AS e, {_CAT_SQL} AS cat, {_CONF} AS conf FROM lineitem), "
    f"o AS (SELECT l_orderkey, list([{{'s': s, 'e': e, 'i': i}}] ORDER BY {_PRIORITY} DESC, e - s DESC, conf DESC, i, s, e) AS x FROM c GROUP BY l_orderkey), "
    f"k AS (SELECT l_orderkey, {_GREEDY.format('x')} AS kept FROM o) "
    "SELECT l_orderkey, array_to_string(list_transform(list_sort(list_transform(kept, lambda k: k.i)), lambda i: 'e' || i), ',') AS kept FROM k"
)
def resolve_conflicts(spark, sf_dir):
    """Of overlapping spans of an order's lines, those that conflict resolution keeps."""
    rows = _lines(spark, sf_dir, f"array(named_struct('s', cast({_S} AS int), 'e', cast({_E} AS int)))")
    return rows.select("l_orderkey", F.expr(f"array_join(transform({resolve.resolve_sql('cc')}, x -> x.c.f.t), ',')").alias("kept"))


@query(
    f"WITH c AS (SELECT l_orderkey, l_linenumber AS i, [{{'s': {_S}, 'e': {_E}, 'i': l_linenumber}}, {{'s': {_S} + 40, 'e': {_E} + 40, 'i': l_linenumber}}] AS offs FROM lineitem), "
    "o AS (SELECT l_orderkey, list(offs ORDER BY i, offs) AS x FROM c GROUP BY l_orderkey), "
    "k AS (SELECT l_orderkey, list_reduce(list_prepend([], x), lambda a, x: list_concat(a, list_filter(x, lambda o: len(list_filter(a, lambda k: o.s < k.e AND o.e > k.s)) = 0))) AS kept FROM o) "
    "SELECT l_orderkey, array_to_string(list_transform(kept, lambda k: k.i || ':' || k.s || '-' || k.e), ',') AS kept FROM k"
)
def block_spans(spark, sf_dir):
    """Candidates with two spans each, in order, without what earlier ones block; a candidate's own spans don't."""
    rows = _lines(spark, sf_dir, f"array(named_struct('s', cast({_S} AS int), 'e', cast({_E} AS int)), named_struct('s', cast({_S} + 40 AS int), 'e', cast({_E} + 40 AS int)))")
    rows = rows.withColumn("cc", F.expr(f"transform(cc, c -> cast(named_struct('p', 1, 'cat', c.cat, 't', c.f.t, 'conf', c.conf, 'src', c.src, 'occ', 2, 'offs', c.offs, 'review', c.review, 'feats', c.feats) AS {resolve.CANDIDATE}))"))
    kept = f"flatten(transform({resolve.block_sql('cc')}, c -> transform(c.offs, o -> concat(substring(c.t, 2), ':', o.s, '-', o.e))))"
    return rows.select("l_orderkey", F.expr(f"array_join({kept}, ',')").alias("kept"))


@query(
    f"WITH c AS (SELECT l_orderkey, l_linenumber AS i, {_S} AS s, {_E} AS e FROM lineitem), o AS (SELECT l_orderkey, list([{{'s': s, 'e': e, 'i': i}}] ORDER BY e - s DESC, s, i) AS x FROM c GROUP BY l_orderkey), "
    f"k AS (SELECT l_orderkey, {_GREEDY.format('x')} AS kept FROM o) SELECT l_orderkey, array_to_string(list_transform(list_sort(list_transform(kept, lambda k: [k.s, k.e])), lambda k: k[1] || '-' || k[2]), ',') AS kept FROM k"
)
def longest_spans(spark, sf_dir):
    """The longest spans first, then the earliest, none overlapping: how dates of several patterns are united."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.expr(f"named_struct('s', cast({_S} AS int), 'e', cast({_E} AS int))").alias("c")).alias("x"))
    rows = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("x")).alias("x")).select("l_orderkey", F.transform("x", lambda y: y["c"]).alias("cc"))
    return rows.select("l_orderkey", F.expr(f"array_join(transform({resolve.without_overlaps('cc', 'struct<s: int, e: int>')}, o -> concat(o.s, '-', o.e)), ',')").alias("kept"))


@query(
    f"WITH c AS (SELECT l_orderkey, l_linenumber, {_CAT_SQL} AS cat, {_CONF} AS conf, {_SRC_SQL} AS src FROM lineitem), "
    "r AS (SELECT *, CASE WHEN cat IN ('email', 'iban', 'telefon') AND conf >= 0.75 THEN NULL WHEN src = 'ner' AND cat = 'person' AND conf >= 0.88 THEN NULL WHEN src = 'ner' AND cat = 'person' AND conf < 0.72 THEN 'ner_low_confidence' "
    "WHEN conf >= 0.90 THEN NULL WHEN cat = 'person' AND conf < 0.85 THEN 'person_mid_confidence' WHEN conf < 0.85 THEN 'below_threshold' END AS review_reason FROM c) "
    "SELECT l_orderkey, l_linenumber, cat AS category, src AS detection_source, conf AS confidence, review_reason IS NOT NULL AS needs_review, review_reason FROM r WHERE conf >= 0.75"
)
def score_table(spark, sf_dir):
    """Every rule of the score table, over all categories, sources and confidences; those that a review accepts beforehand."""
    c = f"named_struct('f', {_FACE}, 'cat', {_CAT}, 'conf', {_CONF}, 'src', {_SRC}, 'review', false, 'feats', cast(map() AS map<string, string>))"
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(f"array(named_struct('c', {c}, 'offs', array(named_struct('s', 0, 'e', 1))))").alias("r"))
    made = rows.select("l_orderkey", "l_linenumber", F.expr(resolve.score_sql("r")).getItem(0).alias("e"))
    return accepted(made.select("l_orderkey", "l_linenumber", "e.category", "e.detection_source", "e.confidence", "e.needs_review", F.col("e.features")["review_reason"].alias("review_reason")))


@query(
    f"SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || ' Weber' AS entity, 'person' AS category, CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.84 END AS confidence, 3 AS occurrences, CASE WHEN c_custkey % 3 = 0 THEN 'ner' ELSE 'lexicon' END AS source FROM customer "
    "UNION ALL SELECT c_custkey, 'Weber ' || c_custkey || ' GmbH', 'firma', 0.95, 1, 'rule' FROM customer"
)
def merge_entities(spark, sf_dir):
    """Forms of one person, with and without title, are one entity with the surest confidence and strongest source; a company isn't."""
    name = f"concat(element_at({_SPARK_FIRST}, cast(c_custkey % 5 + 1 AS int)), ' Weber')"
    one = lambda t, cat, conf, src, s: f"cast(named_struct('p', 10, 'cat', '{cat}', 't', {t}, 'conf', cast({conf} AS double), 'src', {src}, 'occ', 1, 'offs', array(named_struct('s', {s}, 'e', {s} + 5)), 'review', false, 'feats', cast(map() AS map<string, string>)) AS {resolve.CANDIDATE})"
    found = f"array({one(name, 'person', '0.78', chr(39) + 'lexicon' + chr(39), 0)}, {one(f'concat({chr(39)}Herr Dr. {chr(39)}, {name})', 'person', 'CASE WHEN c_custkey % 2 = 0 THEN 0.9 ELSE 0.84 END', chr(39) + 'rule' + chr(39), 20)}, {one(f'upper({name})', 'person', '0.8', 'CASE WHEN c_custkey % 3 = 0 THEN ' + chr(39) + 'ner' + chr(39) + ' ELSE ' + chr(39) + 'lexicon' + chr(39) + ' END', 40)}, {one(f'concat({chr(39)}Weber {chr(39)}, c_custkey, {chr(39)} GmbH{chr(39)})', 'firma', '0.95', chr(39) + 'rule' + chr(39), 60)})"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(found).alias("cc")).select("c_custkey", F.explode(F.expr(resolve.merge_sql("cc"))).alias("e"))
    return rows.select("c_custkey", F.expr("CASE WHEN e.cat = 'person' THEN initcap(e.f.t) ELSE e.f.t END").alias("entity"), F.col("e.cat").alias("category"), F.col("e.conf").alias("confidence"), F.col("e.occ").alias("occurrences"), F.col("e.src").alias("source"))


@query(
    "SELECT c_custkey, 'Hauptstraße ' || (c_custkey % 90 + 1) || CASE WHEN c_custkey % 100 > 0 THEN chr(10) || lpad(cast(c_custkey % 100 AS VARCHAR), 2, '0') || '345 Berlin' ELSE '' END AS entity, "
    "CASE WHEN c_custkey % 100 > 0 THEN 0.88 ELSE 0.82 END AS confidence, CASE WHEN c_custkey % 100 > 0 THEN 'parser' ELSE 'rule' END AS detection_source FROM customer"
)
def address_blocks(spark, sf_dir):
    """A street and a valid postcode on the next line are one address; without a valid one the street stands alone."""
    rows = resolve.entity_rows(resolve.detect(spread(customer_notes(spark, sf_dir))), "c_custkey")
    return rows.filter("category = 'ort'").select("c_custkey", "entity", "confidence", "detection_source")


@query("SELECT c_custkey, '0170' || lpad(cast(c_custkey AS VARCHAR), 7, '0') AS mention, CASE WHEN c_custkey % 3 = 0 THEN 0.92 ELSE 0.84 END AS confidence FROM customer")
def phone_context(spark, sf_dir):
    """A cue in the hundred bytes before makes a phone number surer; one further away doesn't."""
    note = "concat('Telefon ', CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('ü', 60) ELSE repeat('x', 120) END, ' 0170', lpad(cast(c_custkey AS string), 7, '0'))"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text"))
    return extract(rows, _PASSES.get("phone_compact"), "text", ["c_custkey"]).select("c_custkey", "mention", "confidence")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%y') AS mention, CASE WHEN o_orderkey % 3 = 0 THEN 0.93 ELSE 0.91 END AS confidence FROM orders WHERE o_orderkey % 5 > 0")
def birth_dates(spark, sf_dir):
    """Dates of two-digit years, surer as dates of birth if the eight words before say so; none that isn't in the calendar."""
    day = "CASE WHEN o_orderkey % 5 = 0 THEN '31.02.' ELSE date_format(o_orderdate, 'dd.MM.') END"
    note = f"concat(CASE o_orderkey % 3 WHEN 0 THEN 'geboren am ' WHEN 1 THEN 'geliefert am ' ELSE 'geboren vor acht Worten oder mehr als acht Worten am ' END, {day}, date_format(o_orderdate, 'yy'), '.')"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(note).alias("text"))
    return extract(rows, _PASSES.get("date_dot"), "text", ["o_orderkey"]).select("o_orderkey", "mention", "confidence")


@query(f"SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || CASE WHEN c_custkey % 2 = 0 THEN ' Weber' ELSE '' END AS mention, 1 AS n FROM customer WHERE c_custkey % 4 > 1")
def person_negatives(spark, sf_dir):
    """Letters to persons; stop words in a name's place are no persons."""
    stop = lexicon.PERSON_STOPWORDS[0]
    note = f"concat('Liebe ', CASE WHEN c_custkey % 4 < 2 THEN '{stop}' ELSE element_at({_SPARK_FIRST}, cast(c_custkey % 5 + 1 AS int)) END, CASE WHEN c_custkey % 2 = 0 THEN ' Weber' ELSE '' END, ', danke.')"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text"))
    return extract(rows, _PASSES.get("person_dear"), "text", ["c_custkey"]).groupBy("c_custkey", "mention").agg(F.count("*").alias("n"))


@query(f"SELECT false AS available, NULL::VARCHAR AS model_dir, '{','.join(ner.FILES)}' AS needs, '{','.join(ner.LABELS)}' AS labels, {ner.MAX_TOKENS} AS max_tokens")
def ner_no_model(spark, sf_dir):
    """Without a model's folder there is no model."""
    return ner.ner_status(spark, "/nowhere")


@query(
    "WITH l AS (SELECT l_orderkey, l_linenumber, [cast(l_linenumber AS DOUBLE), cast(l_partkey % 7 AS DOUBLE), cast(l_suppkey % 7 AS DOUBLE), cast(l_orderkey % 7 AS DOUBLE)] AS x FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, list_position(x, list_max(x)) - 1 AS label, round(1 / list_sum(list_transform(x, lambda v: exp(v - list_max(x)))), 9) AS confidence FROM l"
)
def softmax_argmax(spark, sf_dir):
    """The label of the largest logit, the first of equals, and its probability."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("transform(array(l_linenumber, l_partkey % 7, l_suppkey % 7, l_orderkey % 7), v -> cast(v AS double))").alias("x"))
    return rows.select("l_orderkey", "l_linenumber", F.expr(ner.softmax_argmax("x")).alias("y")).select("l_orderkey", "l_linenumber", "y.label", F.round("y.conf", 9).alias("confidence"))


_EXT = "CASE p_partkey % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.docx' WHEN 2 THEN '.pdf' WHEN 3 THEN '.xlsm' ELSE '' END"


@query(
    f"WITH p AS (SELECT p_partkey, 'in.put/' || p_partkey || {_EXT} AS path FROM part) SELECT p_partkey, lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN ({_LIST(files.EXTENSIONS)}) AS supported, "
    "CASE WHEN p_partkey % 5 < 4 THEN regexp_replace(path, '(\\.[^./]*)$', '_anonym\\1') ELSE path END AS target FROM p"
)
def file_names(spark, sf_dir):
    """Which files can be read, and how their rewritten copies are called."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"concat('in.put/', p_partkey, {_EXT})").alias("path"))
    return rows.select("p_partkey", files.supported(F.col("path")).alias("supported"), files.output_path(F.col("path"), "encode").alias("target"))


@query(
    "SELECT s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.txt' ELSE '.md' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'txt' ELSE 'md' END AS format, s_name || ' ß' || chr(10) || s_suppkey AS content FROM supplier "
    "UNION ALL SELECT s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '_anonym.txt' ELSE '_anonym.md' END, CASE WHEN s_suppkey % 2 = 0 THEN 'txt' ELSE 'md' END, replace(s_name || ' ß' || chr(10) || s_suppkey, 'Supplier', 'Firma') FROM supplier"
)
def text_files(spark, sf_dir):
    """A text file a supplier, written by the tasks, read, copied with a replacement beside it, and read again."""
    folder = new_folder(spark, "files")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    name = "concat(s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN '.txt' ELSE '.md' END)"
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{folder}/"), F.expr(name)).alias("target"), F.expr("concat(s_name, ' ß', chr(10), s_suppkey)").cast("binary").alias("data"))
    files.write_copies(rows)
    files.write_copies(files.copies(spark, folder, [("Supplier", "Firma")]).select("target", "data"))
    return files.read_documents(spark, folder).select(F.element_at(F.split("source_path", "/"), -1).alias("name"), "format", "content")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'an Firma' || s_suppkey || '!' ELSE 'an ' || s_name || '!' END AS text, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS replacements_made FROM supplier")
def confirmed_only(spark, sf_dir):
    """Entries that aren't confirmed replace nothing; those that are, are counted."""
    suppliers = table(spark, sf_dir, "supplier")
    mapping = suppliers.select(F.col("s_name").alias("original"), F.concat(F.lit("Firma"), "s_suppkey").alias("surrogate"), F.expr("s_suppkey % 2 = 0").alias("confirmed"))
    return substitute.encode(suppliers.select("s_suppkey", F.concat(F.lit("an "), "s_name", F.lit("!")).alias("text")), mapping)


@query(
    f"WITH o AS ({_EMAILS}), t AS (SELECT DISTINCT lower(original) AS term FROM o), "
    "f AS (SELECT doc_id, term, unnest(list_filter(range(length(text)), lambda i: substr(lower(text), cast(i AS BIGINT) + 1, length(term)) = term)) AS s FROM documents, t WHERE contains(lower(text), term)), "
    "g AS (SELECT doc_id, list([{'s': s, 'e': s + length(term), 'term': term}] ORDER BY strlen(term) DESC, term, s) AS x FROM f GROUP BY doc_id), "
    f"k AS (SELECT doc_id, unnest({_GREEDY.format('x')}) AS y FROM g) SELECT doc_id, cast(y.s AS INTEGER) AS start, cast(y.e AS INTEGER) AS \"end\", y.term AS term FROM k"
)
def highlight_places(spark, sf_dir):
    """Places of mapped addresses in any case, the longest first, none overlapping."""
    return substitute.highlight(table(spark, sf_dir, "documents").select("doc_id", "text"), _email_map(spark, sf_dir)).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.term")


# --- review -------------------------------------------------------------------------------------------------------------------


@query(
    f"WITH n AS (SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || ' Weber' AS t FROM customer), "
    "r AS (SELECT c_custkey, t, CASE c_custkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.87 WHEN 2 THEN 0.87 ELSE 0.8 END AS conf FROM n) "
    "SELECT c_custkey, t AS entity, conf AS confidence, c_custkey % 4 IN (1, 3) AS needs_review, CASE WHEN c_custkey % 3 = 0 THEN 'seen' WHEN c_custkey % 4 = 3 THEN 'person_mid_confidence' END AS review_reason, "
    "CASE WHEN c_custkey % 2 = 0 THEN 'one' ELSE 'two' END AS origin FROM r"
)
def review_state(spark, sf_dir):
    """Merged forms need a review if one of them does and no rule decides; features are the first ones' that have them."""
    name = f"concat(element_at({_SPARK_FIRST}, cast(c_custkey % 5 + 1 AS int)), ' Weber')"
    one = lambda t, conf, s, flag, feats: f"cast(named_struct('p', 10, 'cat', 'person', 't', {t}, 'conf', cast({conf} AS double), 'src', 'rule', 'occ', 1, 'offs', array(named_struct('s', {s}, 'e', {s} + 5)), 'review', {flag}, 'feats', {feats}) AS {resolve.CANDIDATE})"
    surest = "CASE c_custkey % 4 WHEN 0 THEN 0.95 WHEN 1 THEN 0.87 WHEN 2 THEN 0.87 ELSE 0.8 END"
    reason = "CASE WHEN c_custkey % 3 = 0 THEN map('review_reason', 'seen') ELSE cast(map() AS map<string, string>) END"
    first = one(f"concat('Herr ', {name})", surest, 0, "false", "CASE WHEN c_custkey % 2 = 0 THEN map('origin', 'one') ELSE cast(map() AS map<string, string>) END")
    found = f"array({one(name, 0.7, 20, 'c_custkey % 4 < 2', f'map_concat(map({chr(39)}origin{chr(39)}, {chr(39)}two{chr(39)}), {reason})')}, {first})"
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(f"cast({found} AS array<{resolve.CANDIDATE}>)").alias("cc")).withColumn("cc", F.expr(resolve.merge_sql("cc")))
    scored = rows.select("c_custkey", F.explode(F.expr(resolve.score_sql(resolve.resolve_sql("cc")))).alias("e"))
    return scored.select("c_custkey", F.col("e.text").alias("entity"), F.col("e.confidence").alias("confidence"), F.col("e.needs_review").alias("needs_review"), F.col("e.features")["review_reason"].alias("review_reason"), F.col("e.features")["origin"].alias("origin"))


def _reviewed(spark, sf_dir):
    """Customers detected with different confidences; a third reviewed, with overrides, unticked ones and blank overrides."""
    rows = table(spark, sf_dir, "customer")
    detected = rows.select(F.col("c_name").alias("entity"), F.lit("person").alias("category"), F.expr("cast(60 + c_custkey % 40 AS double) / 100").alias("confidence"))
    reviews = rows.filter("c_custkey % 3 = 0").select(
        F.expr("CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END").alias("entity"), F.expr("c_custkey % 9 <> 0").alias("checked"), F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('  ', c_name, ' AG ') WHEN 1 THEN ' ' END").alias("text"),
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'firma' END").alias("category"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN concat('S', c_custkey) END").alias("surrogate"),
    )
    return detected, reviews


_PROJECTED = (
    "WITH d AS (SELECT c_custkey AS k, c_name, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 9 <> 0 ELSE (60 + c_custkey % 40) / 100 >= 0.75 END AS ticked, c_custkey % 3 = 0 AS reviewed FROM customer), "
    "p AS (SELECT k, c_name || CASE WHEN reviewed AND k % 4 = 0 THEN ' AG' ELSE '' END AS original, CASE WHEN reviewed AND k % 4 = 0 THEN 'firma' ELSE 'person' END AS category, CASE WHEN reviewed AND k % 5 = 0 THEN 'S' || k END AS surrogate, reviewed FROM d WHERE ticked)"
)


@query(_PROJECTED + " SELECT original, category, surrogate, reviewed FROM p")
def review_projection(spark, sf_dir):
    """Ticked entities with their overrides, as entries to add."""
    return review.projected(*_reviewed(spark, sf_dir))


@query(
    _PROJECTED + ", s AS (SELECT upper(c_name) || CASE WHEN c_custkey % 4 = 0 THEN ' AG' ELSE '' END AS original, 'person' AS category, 'S' || c_custkey AS surrogate FROM customer WHERE c_custkey % 2 = 0) "
    "SELECT coalesce(s.original, p.original) AS original, coalesce(s.category, p.category) AS category, CASE WHEN s.original IS NULL THEN p.surrogate ELSE s.surrogate END AS surrogate, "
    "CASE WHEN s.original IS NOT NULL THEN 'stored' WHEN p.reviewed THEN 'reviewed' ELSE 'detected' END AS origin, CASE WHEN s.category <> p.category THEN 'category' END AS conflict "
    "FROM p FULL JOIN s ON lower(s.original) = lower(p.original)"
)
def review_merge(spark, sf_dir):
    """Stored, reviewed and detected entries, one a key, with where they came from and what they disagree in."""
    stored = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.expr("upper(c_name) || CASE WHEN c_custkey % 4 = 0 THEN ' AG' ELSE '' END").alias("original"), F.lit("person").alias("category"), F.expr("concat('S', c_custkey)").alias("surrogate"))
    return review.merged(stored, review.projected(*_reviewed(spark, sf_dir)))


@query(
    _PROJECTED + ", free AS (SELECT original, category, CASE category WHEN 'person' THEN 'Person' ELSE 'Company' END || '-' || row_number() OVER (PARTITION BY category ORDER BY reviewed DESC, lower(original)) AS surrogate FROM p WHERE surrogate IS NULL) "
    "SELECT original, category, surrogate FROM p WHERE surrogate IS NOT NULL UNION ALL SELECT * FROM free"
)
def review_grown(spark, sf_dir):
    """The mapping that a review leaves: reviewed entries are numbered before detected ones."""
    return review.grown(m.empty(spark), *_reviewed(spark, sf_dir)).select("original", "category", "surrogate")


# --- gates ------------------------------------------------------------------------------------------------------------------


def _unicode_notes(spark, sf_dir):
    """Companies behind no-break spaces, amounts in Arabic digits."""
    digits = "translate(cast(c_custkey AS string), '0123456789', '٠١٢٣٤٥٦٧٨٩')"
    note = f"concat('bei der Nordwind', char(CASE WHEN c_custkey % 2 = 0 THEN 160 ELSE 32 END), 'GmbH gekauft, kostet ', {digits}, ' EUR')"
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text"))


@query("SELECT c_custkey, 'Nordwind' || chr(CASE WHEN c_custkey % 2 = 0 THEN 160 ELSE 32 END) || 'GmbH' AS mention, 1 AS confidence_rank FROM customer")
def company_spaces(spark, sf_dir):
    """Legal forms behind any white space."""
    return extract(_unicode_notes(spark, sf_dir), _PASSES.get("company_legal"), "text", ["c_custkey"]).select("c_custkey", "mention", F.expr("CASE WHEN confidence = 0.95D THEN 1 ELSE 0 END").alias("confidence_rank"))


@query("SELECT c_custkey, translate(cast(c_custkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' EUR' AS mention, 55 + 0 * c_custkey AS start_char FROM customer")
def money_digits(spark, sf_dir):
    """Amounts in digits of any script; the place is one in bytes, here told as the characters before it."""
    rows = extract(_unicode_notes(spark, sf_dir), _PASSES.get("money_suffix_word"), "text", ["c_custkey"])
    return rows.select("c_custkey", "mention", (F.col("start") + 17 - F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(0)).alias("start_char"))


# --- files through the mapping -------------------------------------------------------------------------------------------------


def _word_files(frames):
    """A Word file a row (target, name): the name split over two pieces of different format, and an address in an entity."""
    import io
    import zipfile

    import pandas as pd

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    for frame in frames:
        made = []
        for name in frame["name"]:
            out = io.BytesIO()
            body = f"<w:p><w:r><w:t>an {name[:5]}</w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>{name[5:]}</w:t></w:r><w:r><w:t>!</w:t></w:r></w:p><w:p><w:r><w:t>{name} &amp; {name}</w:t></w:r></w:p>"
            with zipfile.ZipFile(out, "w") as z:
                z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
            made.append(out.getvalue())
        yield pd.DataFrame({"target": frame["target"], "data": made})


@query(
    "SELECT s_suppkey, 'an Firma-' || s_suppkey || '!' || chr(10) || 'Firma-' || s_suppkey || ' & Firma-' || s_suppkey AS encoded, 3 AS replacements_made, "
    "'an ' || s_name || '!' || chr(10) || s_name || ' & ' || s_name AS decoded, 3 AS decoded_replacements FROM supplier"
)
def mapped_files(spark, sf_dir):
    """A Word file a supplier, rewritten through the mapping of all suppliers and back; terms reach over pieces of a paragraph."""
    folders = [new_folder(spark, "word") for _ in range(2)]
    for folder in folders:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(hadoop)
    suppliers = table(spark, sf_dir, "supplier")
    mapping = suppliers.select(F.col("s_name").alias("original"), F.concat(F.lit("Firma-"), "s_suppkey").alias("surrogate"), F.lit(True).alias("confirmed"))
    first = files.write_copies(suppliers.select(F.concat(F.lit(f"{folders[0]}/"), "s_suppkey", F.lit(".docx")).alias("target"), F.col("s_name").alias("name")).mapInPandas(_word_files, "target string, data binary"))
    there = files.mapped_copies(spark, first, mapping)
    second = files.write_copies(there.select(F.regexp_replace("target", "^.*/", f"{folders[1]}/").alias("target"), "data"))
    back = files.mapped_copies(spark, second, mapping, "decode")
    key = F.regexp_extract("path", "/([0-9]+)[^/]*$", 1).cast("long").alias("s_suppkey")
    read = lambda df: df.select(key, F.col("replacements_made"), F.col("data"))
    text = F.pandas_udf(_word_text, "string")
    one = read(there).select("s_suppkey", text("data").alias("encoded"), "replacements_made")
    two = read(back).select("s_suppkey", text("data").alias("decoded"), F.col("replacements_made").alias("decoded_replacements"))
    return one.join(two, "s_suppkey")


def _word_text(data: pd.Series) -> pd.Series:
    return data.map(lambda d: files.read_word(bytes(d)).strip())


# --- listed persons and groups of mentions -------------------------------------------------------------------------------

# What stands after 'heute kam ', and what of it is a person: words of office are cut from its end, but one word stays; a
# particle may come first; names that are words, too, are none.
_COMERS = ["Anna Weber Manager", "Rose Weber", "Von Petra Weber", "Klaus Team Lead", "Anna  Weber Project Manager", "Nordlicht Weber", "Klaus-Peter Weber"]
_PERSONS = ["'Anna Weber'", "NULL", "'Von Petra Weber'", "'Klaus'", "'Anna  Weber'", "NULL", "NULL"]


@query(
    "SELECT * FROM (SELECT c_custkey, CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(_PERSONS)) + " END AS mention, CASE WHEN c_custkey % 7 = 3 THEN 0.72 ELSE 0.78 END AS confidence, "
    "11 AS start, 11 + strlen(mention) AS \"end\" FROM customer) WHERE mention IS NOT NULL"
)
def person_tails(spark, sf_dir):
    """Listed persons with words of office behind them, particles before them, and names that are excluded."""
    note = "concat('heute käm ', CASE c_custkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_COMERS)) + " END, ' und ging.')"
    named = Passes(tuple(rules(first_names=["Anna", "Petra", "Klaus", "Rose"])))
    return extract(table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text")), named.get("person_listed"))


_FAR = "'und so weiter und so fort, wie es schon immer war und auch in aller Zukunft ganz sicher bleiben wird; '"
_NUMBER = "'030' || lpad(cast(c_custkey % 1000000 AS {string}), 7, '1')"


def _grouped_note(string: str) -> str:
    """A place, a phone number and a date twice, a person once greeted and once named; even and odd customers in other order."""
    n = _NUMBER.format(string=string)
    either = lambda one, two: f"CASE WHEN c_custkey % 2 = 0 THEN {one} ELSE {two} END"
    parts = ["'Liebe Anna Weber, ß in '", either("'Zürich und ZÜRICH; '", "'ZÜRICH und Zürich; '"), either("'Tel. '", "'Num. '"), n, "'; '", _FAR, either("'Num. '", "'Tel. '"), n, "'; '", _FAR]
    parts += [either("'geboren am '", "'seit dem '"), "'12.05.2001; '", _FAR, either("'seit dem '", "'verstorben am '"), "'12.05.2001; '", _FAR, "'danke, Anna Weber'"]
    return " || ".join(f"({p})" for p in parts)


@query(
    f"WITH c AS (SELECT c_custkey, {_grouped_note('VARCHAR')} AS note, {_NUMBER.format(string='VARCHAR')} AS number FROM customer), "
    "g AS (SELECT c_custkey, note, 'ort' AS category, CASE WHEN c_custkey % 2 = 0 THEN 'Zürich' ELSE 'ZÜRICH' END AS t, 0.8 AS confidence, 'rule' AS source, NULL AS kind FROM c "
    "UNION ALL SELECT c_custkey, note, 'telefon', number, 0.92, 'rule', NULL FROM c "
    "UNION ALL SELECT c_custkey, note, 'datum', '12.05.2001', CASE WHEN c_custkey % 2 = 0 THEN 0.93 ELSE 0.91 END, 'rule', CASE WHEN c_custkey % 2 = 0 THEN 'geburtsdatum' ELSE 'datum' END FROM c "
    "UNION ALL SELECT c_custkey, note, 'person', 'Anna Weber', 0.83, 'lexicon', NULL FROM c) "
    "SELECT c_custkey, category, t AS entity, confidence, source, kind, 2 AS occurrences, strlen(split_part(lower(note), lower(t), 1)) AS first_start, "
    "strlen(note) - strlen(split_part(lower(note), lower(t), 3)) AS last_end FROM g"
)
def grouped_mentions(spark, sf_dir):
    """Mentions of a pass by their keys: places in any case as they first stand, the surest of phone numbers, dates of birth by
    one mention, persons by their names with the strongest source."""
    notes = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_grouped_note("string")).alias("text"))
    passes = Passes(tuple(r for r in rules() if r.id in ("place", "phone_compact", "date_dot", "person_dear", "person_listed")))
    rows = resolve.candidates(spread(notes), passes).select("c_custkey", F.explode("__all").alias("x"))
    return rows.select("c_custkey", F.col("x.cat").alias("category"), F.col("x.t").alias("entity"), F.col("x.conf").alias("confidence"), F.col("x.src").alias("source"), F.col("x.feats")["date_kind"].alias("kind"), F.col("x.occ").alias("occurrences"), F.expr("x.offs[0].s AS first_start"), F.expr("x.offs[1].e AS last_end"))
