"""A query for each operator over the tables, and SQL that gives the same rows.

The tables hold few entities, so many queries run over notes made from structured columns; both engines make the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon, text
from ..operators import evaluate as ev
from ..operators import mapping as m
from ..operators import ner, resolve, substitute
from ..operators.extract import extract
from ..operators.rules import Passes
from ..storage import written
from .pipeline import pseudonymize, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_PASSES = Passes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _mentions(docs: DataFrame, rule: str, key: str) -> DataFrame:
    """(key, mention, n) of one rule."""
    return extract(docs, _PASSES.get(rule), "text", [key]).groupBy(key, "mention").agg(F.count("*").alias("n"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _counted(inner: str, key: str = "doc_id") -> str:
    return f"SELECT {key}, mention, count(*) AS n FROM ({inner}) WHERE mention IS NOT NULL GROUP BY {key}, mention"


# --- notes made from columns: expressions that both engines understand -------------------------------------------------

_FIRST = "['Anna', 'Martin', 'Thomas', 'Petra', 'Klaus']"
_SPARK_FIRST = "array('Anna', 'Martin', 'Thomas', 'Petra', 'Klaus')"
_BBAN = "'37040044' || lpad(cast(c_custkey AS {string}), 10, '0')"
_CHECK = "98 - cast(cast('37040044' || lpad(cast(c_custkey AS {string}), 10, '0') || '131400' AS {wide}) % 97 AS int) + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END"


def _iban(string: str, wide: str) -> str:
    return f"'DE' || lpad(cast({_CHECK.format(string=string, wide=wide)} AS {string}), 2, '0') || {_BBAN.format(string=string)}"


def customer_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account, phone, person, address of every customer, in German prose."""
    note = (
        f"'Ansprechpartner: ' || element_at({_SPARK_FIRST}, cast(c_custkey % 5 + 1 AS int)) || ' Weber, Telefon 0170' || lpad(cast(c_custkey AS string), 7, '0') || '. IBAN ' || {_iban('string', 'decimal(38,0)')}"
        " || '.' || chr(10) || 'Hauptstraße ' || cast(c_custkey % 90 + 1 AS string) || chr(10) || lpad(cast(c_custkey % 100 AS string), 2, '0') || '345 Berlin'"
    )
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text"))


def order_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and amount of every order, in German prose."""
    note = "'Lieferung am ' || date_format(o_orderdate, 'dd.MM.yyyy') || ', gemeldet ' || date_format(o_orderdate, 'yyyy-MM-dd') || ', Betrag ' || cast(cast(floor(o_totalprice) AS bigint) AS string) || ' EUR, Rest $' || cast(o_orderkey % 1000 AS string)"
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.expr(note).alias("text"))


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product code, context and mark of every part."""
    note = "'Typ X' || cast(p_size AS string) || 'b, von Siemens und Partner Acme; ' || replace(p_name, ' ', '-') || '™'"
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(note).alias("text"))


# --- scans and predicates ------------------------------------------------------------------------------------------------


@query("SELECT lang, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY lang")
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{label}', {p})" for c, label, p in lexicon.CATEGORIES) + ") t(category, label, priority)")
def category_dim(spark, sf_dir):
    return m.category_dim(spark)


# --- rules over the tables -------------------------------------------------------------------------------------------------


@query(_counted(r"SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS mention FROM documents"))
def det_email(spark, sf_dir):
    return _mentions(_docs(spark, sf_dir), "email", "doc_id")


@query(
    _counted(
        r"""SELECT doc_id, mention FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\+\d{1,3}[\s./-]?|\b\d{1,3}[\s./-]?)(?:\(\d{2,5}\)|\d{2,5})(?:[\s./-]\d+)+\b')) AS mention FROM documents)
        WHERE NOT regexp_matches(trim(mention), '^\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}$') AND length(regexp_replace(mention, '[^0-9]', '', 'g')) BETWEEN 6 AND 15
        AND (regexp_matches(mention, '[^0-9\s]') OR length(regexp_replace(mention, '[^0-9]', '', 'g')) >= 10 OR regexp_matches(regexp_replace(mention, '\s', '', 'g'), '^(015|016|017|0137)'))"""
    )
)
def det_phone_grouped(spark, sf_dir):
    return _mentions(_docs(spark, sf_dir), "phone_grouped", "doc_id")


@query(
    _counted(
        r"SELECT doc_id, mention FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{Nd}_]+')) AS mention FROM documents) WHERE regexp_full_match(mention, '\p{Lu}{2,5}') AND mention NOT IN ("
        + ", ".join(f"'{w}'" for w in lexicon.ABBREVIATION_STOPWORDS)
        + ")"
    )
)
def det_abbreviation(spark, sf_dir):
    return _mentions(_docs(spark, sf_dir), "abbreviation", "doc_id")


@query(_counted(r"""SELECT page_id, mention FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '[„"»«]([^„"»«\n]{2,50})["»«„]', 1)), ' ' || chr(9) || chr(10) || chr(13)) AS mention FROM pages) WHERE mention <> ''""", "page_id"))
def det_quoted(spark, sf_dir):
    return _mentions(spread(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))), "quoted", "page_id")


# --- rules over notes --------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, {_iban('VARCHAR', 'HUGEINT')} AS mention, 1 AS n FROM customer WHERE c_custkey % 3 <> 0")
def det_iban(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "iban", "c_custkey")


@query("SELECT c_custkey, '0170' || lpad(cast(c_custkey AS VARCHAR), 7, '0') AS mention, 1 AS n FROM customer")
def det_phone_compact(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "phone_compact", "c_custkey")


@query("SELECT c_custkey, 'Hauptstraße ' || cast(c_custkey % 90 + 1 AS VARCHAR) AS mention, 1 AS n FROM customer")
def det_street(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "street", "c_custkey")


@query("SELECT c_custkey, lpad(cast(c_custkey % 100 AS VARCHAR), 2, '0') || '345 Berlin' AS mention, 1 AS n FROM customer WHERE c_custkey % 100 > 0")
def det_postcode(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "postcode", "c_custkey")


@query(f"SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || ' Weber' AS mention, 1 AS n FROM customer")
def det_person_context(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "person_context", "c_custkey")


@query(f"SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || ' Weber' AS mention, 1 AS n FROM customer")
def det_person_listed(spark, sf_dir):
    return _mentions(customer_notes(spark, sf_dir), "person_listed", "c_custkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS mention, 1 AS n FROM orders WHERE year(o_orderdate) BETWEEN 1900 AND 2030")
def det_date_dot(spark, sf_dir):
    return _mentions(order_notes(spark, sf_dir), "date_dot", "o_orderkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS mention, 1 AS n FROM orders WHERE year(o_orderdate) BETWEEN 1900 AND 2030")
def det_date_iso(spark, sf_dir):
    return _mentions(order_notes(spark, sf_dir), "date_iso", "o_orderkey")


@query("SELECT o_orderkey, cast(cast(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' EUR' AS mention, 1 AS n FROM orders")
def det_money_suffix_word(spark, sf_dir):
    return _mentions(order_notes(spark, sf_dir), "money_suffix_word", "o_orderkey")


@query("SELECT o_orderkey, '$' || cast(o_orderkey % 1000 AS VARCHAR) AS mention, 1 AS n FROM orders")
def det_money_prefix_symbol(spark, sf_dir):
    return _mentions(order_notes(spark, sf_dir), "money_prefix_symbol", "o_orderkey")


@query("SELECT p_partkey, 'X' || cast(p_size AS VARCHAR) || 'b' AS mention, 1 AS n FROM part")
def det_product_context(spark, sf_dir):
    return _mentions(part_notes(spark, sf_dir), "product_context", "p_partkey")


@query("SELECT p_partkey, 'Typ X' || cast(p_size AS VARCHAR) || 'b' AS mention, 1 AS n FROM part")
def det_product_code(spark, sf_dir):
    return _mentions(part_notes(spark, sf_dir), "product_code", "p_partkey")


@query("SELECT p_partkey, replace(p_name, ' ', '-') AS mention, 1 AS n FROM part WHERE length(p_name) BETWEEN 2 AND 30")
def det_trademark(spark, sf_dir):
    return _mentions(part_notes(spark, sf_dir), "trademark", "p_partkey")


@query("SELECT p_partkey, 'Siemens' AS mention, 1 AS n FROM part")
def det_brand(spark, sf_dir):
    return _mentions(part_notes(spark, sf_dir), "brand", "p_partkey")


@query("SELECT p_partkey, 'Acme' AS mention, 1 AS n FROM part")
def det_company_signal(spark, sf_dir):
    return _mentions(part_notes(spark, sf_dir), "company_signal", "p_partkey")


#: For each customer a word of its own, a day, a year and an amount, in both dialects ({s}: the type of strings).
_WORD = "'Ko' || translate(cast(c_custkey AS {s}), '0123456789', 'abcdefghij')"
_DAY, _YEAR, _AMOUNT = "cast(c_custkey % 28 + 1 AS {s})", "cast(1950 + c_custkey % 70 AS {s})", "cast(c_custkey % 997 + 1 AS {s})"
#: rule: (before what is found, what is found, behind it), and the text of every second customer, in which nothing is.
_PARTS = {
    "person_title": ("'Wir trafen Herr '", _WORD, "' gestern.'", f"'Wir trafen Her ' || {_WORD} || ' gestern.'"),
    "person_greeting": ("'Hallo '", _WORD, "', danke.'", f"'Hallo ' || lower({_WORD}) || ', danke.'"),
    "person_dear": ("'Liebe '", _WORD, "', danke.'", f"'Liebes ' || {_WORD} || ', danke.'"),
    "company_legal": ("'bei der '", f"{_WORD} || ' GmbH'", "' gekauft'", f"'bei der ' || {_WORD} || ' Gmb gekauft'"),
    "company_hyphen": ("'von '", f"'ABX-' || {_WORD}", "' geprüft'", f"'von Abx-' || {_WORD} || ' geprüft'"),
    "company_acronym": ("'von '", f"'KMD ' || {_WORD}", "' geprüft'", f"'von Kmd ' || {_WORD} || ' geprüft'"),
    "place": (f"{_WORD} || ' liegt in '", "CASE c_custkey % 3 WHEN 0 THEN 'Schweden' WHEN 1 THEN 'schweden' ELSE 'SCHWEDEN' END", "'.'", f"{_WORD} || ' liegt in Schwedena.'"),
    "date_day_month": ("'am '", f"{_DAY} || '. März ' || {_YEAR}", "' war es'", f"'am 31. Februar ' || {_YEAR} || ' war es'"),
    "date_month_year": ("'seit '", f"'April ' || {_YEAR}", "' hier'", "'seit April ' || cast(2040 + c_custkey % 70 AS {s}) || ' hier'"),
    "date_slash": ("'am '", f"{_DAY} || '/6/' || {_YEAR}", "' war es'", f"'am ' || {_DAY} || '/13/' || {_YEAR} || ' war es'"),
    "money_suffix_symbol": ("'kostet '", f"'1.' || {_AMOUNT} || '€'", "' netto'", f"'kostet 1.' || {_AMOUNT} || ' Kronen netto'"),
    "money_prefix_code": ("'kostet '", f"'CHF ' || {_AMOUNT}", "' netto'", f"'kostet CHX ' || {_AMOUNT} || ' netto'"),
    "street_preposition": (f"{_WORD} || ', '", f"'Am Markt ' || {_AMOUNT}", "'.'", f"{_WORD} || ', Am markt ' || {_AMOUNT} || '.'"),
}


def _parted(rule: str, before: str, found: str, behind: str, nothing: str):
    """Mentions of one rule in a note a customer, every second one of which holds none, with their places in bytes."""

    def run(spark, sf_dir):
        note = f"CASE WHEN c_custkey % 2 = 0 THEN {before} || {found} || {behind} ELSE {nothing} END".replace("{s}", "string")
        rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(note).alias("text"))
        return extract(rows, _PASSES.get(rule), "text", ["c_custkey"]).select("c_custkey", "mention", "start")

    run.__name__ = f"det_{rule}"
    return run


for _rule, _texts in _PARTS.items():
    query(f"SELECT c_custkey, {_texts[1]} AS mention, cast(strlen({_texts[0]}) AS INTEGER) AS start FROM customer WHERE c_custkey % 2 = 0".replace("{s}", "VARCHAR"))(_parted(_rule, *_texts))


# --- scalar functions ------------------------------------------------------------------------------------------------------


@query(f"SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer")  # noqa: F541
def iban_checksum(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_iban("string", "decimal(38,0)")).alias("t")).select("c_custkey", F.expr(text.iban_valid("t")).alias("valid"))


@query("SELECT o_orderkey, try_cast('2023-' || lpad(cast(o_orderkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(cast(o_orderkey % 33 AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS valid FROM orders")
def date_validity(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(text.date_valid("cast(o_orderkey % 33 AS int)", "cast(o_orderkey % 14 AS int)", "2023")).alias("valid"))


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS key FROM documents")
def normalize_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.expr(text.normalized("text"))).alias("key"))


@query(f"SELECT c_custkey, lower({_FIRST}[c_custkey % 5 + 1]) || ' weber' AS key FROM customer")
def identity_key(spark, sf_dir):
    name = F.expr(f"'Herr Dr. ' || element_at({_SPARK_FIRST}, cast(c_custkey % 5 + 1 AS int)) || ' Weber,'")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("t")).select("c_custkey", F.expr(text.identity("t")).alias("key"))


@query(r"SELECT doc_id, cast((length(text) - length(replace(text, 'the', ''))) / 3 AS INTEGER) AS n FROM documents")
def count_occurrences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.occurrences("text", "'the'").alias("n"))


# --- entities ---------------------------------------------------------------------------------------------------------------


@query(
    "WITH e AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS entity, 'datum' AS category, 0.91 AS confidence, false AS needs_review, 13 AS a FROM orders "
    "UNION ALL SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d'), 'datum', 0.91, false, 34 FROM orders "
    "UNION ALL SELECT o_orderkey, cast(cast(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' EUR', 'betrag', 0.92, false, 53 FROM orders "
    "UNION ALL SELECT o_orderkey, '$' || cast(o_orderkey % 1000 AS VARCHAR), 'betrag', 0.92, false, 64 + length(cast(cast(floor(o_totalprice) AS BIGINT) AS VARCHAR)) FROM orders) "
    "SELECT o_orderkey, entity, category, cast(confidence AS DOUBLE) AS confidence, needs_review, a || '-' || a + length(entity) AS offsets FROM e"
)
def entities_orders(spark, sf_dir):
    """The whole detection over order notes."""
    rows = resolve.entity_rows(resolve.detect(spread(order_notes(spark, sf_dir).select("o_orderkey", "text"))), "o_orderkey")
    return rows.select("o_orderkey", "entity", "category", "confidence", "needs_review", "offsets")


@query()
def entities_documents(spark, sf_dir):
    """The whole detection over documents."""
    return resolve.entity_rows(resolve.detect(_docs(spark, sf_dir)), "doc_id")


#: Where things stand in a customer's note: from the name's length and, behind it, fixed distances in bytes.
_CUSTOMER_ENTITIES = (
    f"WITH c AS (SELECT c_custkey, {_FIRST}[c_custkey % 5 + 1] || ' Weber' AS name, '0170' || lpad(cast(c_custkey AS VARCHAR), 7, '0') AS phone, 'Hauptstraße ' || (c_custkey % 90 + 1) AS street, lpad(cast(c_custkey % 100 AS VARCHAR), 2, '0') || '345 Berlin' AS town, {_iban('VARCHAR', 'HUGEINT')} AS iban FROM customer), "
    "p AS (SELECT *, 27 + length(name) AS pos FROM c), "
    "e AS (SELECT c_custkey, name AS entity, 'person' AS category, 0.84 AS confidence, 'lexicon' AS source, 'person_mid_confidence' AS reason, 17 AS s FROM p UNION ALL SELECT c_custkey, phone, 'telefon', 0.92, 'rule', NULL, pos FROM p "
    "UNION ALL SELECT c_custkey, 'IBAN', 'sonstiges', 0.65, 'rule', 'below_threshold', pos + 13 FROM p UNION ALL SELECT c_custkey, iban, 'iban', 0.97, 'rule', NULL, pos + 18 FROM p WHERE c_custkey % 3 <> 0 "
    "UNION ALL SELECT c_custkey, street || chr(10) || town, 'ort', 0.88, 'parser', NULL, pos + 42 FROM p WHERE c_custkey % 100 > 0 UNION ALL SELECT c_custkey, street, 'ort', 0.82, 'rule', 'below_threshold', pos + 42 FROM p WHERE c_custkey % 100 = 0) "
    "SELECT c_custkey, entity, category, cast(confidence AS DOUBLE) AS confidence, 1 AS occurrences, source AS detection_source, reason IS NOT NULL AS needs_review, NULL::VARCHAR AS date_kind, reason AS review_reason, s || '-' || s + strlen(entity) AS offsets FROM e"
)


@query(_CUSTOMER_ENTITIES)
def entities_customers(spark, sf_dir):
    """The whole detection over customer notes: blocks of street and postcode, persons, accounts, phones."""
    return resolve.entity_rows(resolve.detect(spread(customer_notes(spark, sf_dir))), "c_custkey")


@query(
    "WITH c AS (SELECT c_custkey, c_custkey % 100 > 0 AS town, c_custkey % 3 <> 0 AS account FROM customer) SELECT category, sum(n) AS entities FROM ("
    "SELECT 'person' AS category, count(*) AS n FROM c UNION ALL SELECT 'telefon', count(*) FROM c UNION ALL SELECT 'iban', count(*) FROM c WHERE account "
    "UNION ALL SELECT 'ort', count(*) FROM c UNION ALL SELECT 'sonstiges', count(*) FROM c) GROUP BY category"
)
def entity_counts_by_category(spark, sf_dir):
    """Entities of customer notes by category: each has a person, a phone, an address (block or street) and the word IBAN."""
    rows = resolve.entity_rows(resolve.detect(spread(customer_notes(spark, sf_dir))), "c_custkey")
    return rows.groupBy("category").agg(F.count("*").alias("entities"))


@query(
    "WITH t AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 4 = 0 THEN 'B-PER' WHEN turn % 4 = 3 THEN 'O' ELSE 'I-PER' END AS label FROM conversations), "
    "r AS (SELECT *, label = 'B-PER' OR lag(label) OVER w IS NULL OR lag(label) OVER w = 'O' AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos)), "
    "i AS (SELECT *, sum(cast(new AS INT)) OVER (PARTITION BY conv_id ORDER BY pos) AS run FROM r WHERE label <> 'O') "
    "SELECT conv_id, 'person' AS category, min(pos) AS start, max(pos) + 1 AS \"end\", count(*) AS n_tokens FROM i GROUP BY conv_id, run"
)
def bio_merge(spark, sf_dir):
    tokens = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.expr("CASE WHEN turn % 4 = 0 THEN 'B-PER' WHEN turn % 4 = 3 THEN 'O' ELSE 'I-PER' END").alias("label"), F.lit(0.9).alias("conf"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return ner.merge_tokens(tokens, doc="conv_id").select("conv_id", "category", "start", "end", "n_tokens")


@query()
def ner_status(spark, sf_dir):
    return ner.ner_status(spark)


# --- mapping and substitution ---------------------------------------------------------------------------------------------


def _email_items(spark, sf_dir):
    rows = extract(_docs(spark, sf_dir), _PASSES.get("email"), "text", ["doc_id"]).select(F.col("mention").alias("entity"), F.lit("email").alias("category"))
    return m.from_entities(rows)


def _email_map(spark, sf_dir):
    return written(m.add_bulk(m.empty(spark), _email_items(spark, sf_dir)), "emails")


_EMAILS = r"SELECT DISTINCT unnest(regexp_extract_all(text, '(?i)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')) AS original FROM documents"
_MAP = f"WITH o AS ({_EMAILS}), f AS (SELECT min(original) AS original, lower(original) AS k FROM o GROUP BY lower(original)), s AS (SELECT original, 'Email-' || row_number() OVER (ORDER BY k) AS surrogate FROM f)"


@query(_MAP + " SELECT original, surrogate, 'email' AS category, true AS confirmed FROM s")
def mapping_add_bulk(spark, sf_dir):
    return m.add_bulk(m.empty(spark), _email_items(spark, sf_dir)).select("original", "surrogate", "category", "confirmed")


def _customer_map(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("original"), F.lit("person").alias("category"), F.expr("CASE WHEN c_custkey % 10 = 0 THEN ' Person-' || cast(c_custkey + 1 AS string) END").alias("surrogate"), F.col("c_custkey").alias("position"))
    return m.add_bulk(m.empty(spark), rows)


@query(
    "WITH g AS (SELECT c_custkey AS k, c_name, 'Person-' || (c_custkey + 1) AS s FROM customer WHERE c_custkey % 10 = 0), "
    "free AS (SELECT i, row_number() OVER (ORDER BY i) AS r FROM range(1, 1 + (SELECT 2 * count(*) FROM customer)) t(i) WHERE 'Person-' || i NOT IN (SELECT s FROM g)), "
    "b AS (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS r FROM customer WHERE c_custkey % 10 <> 0) "
    "SELECT c_name AS original, s AS surrogate FROM g UNION ALL SELECT c_name, 'Person-' || i FROM b JOIN free USING (r)"
)
def mapping_numbering(spark, sf_dir):
    """Labels leave out numbers that surrogates given by hand have taken."""
    return _customer_map(spark, sf_dir).select("original", "surrogate")


@query("SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS original, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS surrogate FROM customer")
def mapping_import(spark, sf_dir):
    """Half of the customers are known, written in capitals; all are imported."""
    rows = table(spark, sf_dir, "customer").select(m.entry_id(F.col("c_name")).alias("id"), "c_name", "c_custkey", F.lit("person").alias("category"), F.lit(True).alias("confirmed"))
    make = lambda df, original, s: df.select("id", F.expr(original).alias("original"), F.lit(s).alias("surrogate"), "category", "confirmed")
    return m.import_entries(make(rows.filter("c_custkey % 2 = 0"), "upper(c_name)", "old"), make(rows, "c_name", "new")).select("original", "surrogate")


@query("SELECT c_name AS original, c_custkey % 2 = 0 AS confirmed, CASE WHEN c_custkey % 5 = 0 THEN 'Z' ELSE 'S' END AS surrogate FROM customer")
def mapping_update(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(m.entry_id(F.col("c_name")).alias("id"), F.col("c_name").alias("original"), F.lit("S").alias("surrogate"), F.lit("person").alias("category"), F.lit(True).alias("confirmed"))
    ids = table(spark, sf_dir, "customer").select(m.entry_id(F.col("c_name")).alias("id"), F.expr("CASE WHEN c_custkey % 5 = 0 THEN 'Z' END").alias("surrogate"), F.lit(None).cast("string").alias("category"), F.expr("CASE WHEN c_custkey % 2 = 1 THEN false END").alias("confirmed"))
    return m.update(rows, ids).select("original", "confirmed", "surrogate")


@query("SELECT c_name AS original FROM customer WHERE c_custkey % 7 <> 0")
def mapping_remove(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(m.entry_id(F.col("c_name")).alias("id"), F.col("c_name").alias("original"), F.lit("S").alias("surrogate"), F.lit("person").alias("category"), F.lit(True).alias("confirmed"), "c_custkey")
    return m.remove(base.drop("c_custkey"), base.filter("c_custkey % 7 = 0").select("id")).select("original")


@query("SELECT label, CASE WHEN label = 'Person' THEN (SELECT max(c_custkey) FROM customer) ELSE 0 END AS n FROM (VALUES ('Person')) t(label)")
def counter_rebuild(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("Person-"), F.col("c_custkey").cast("string")).alias("surrogate"), F.lit("person").alias("category"))
    return m.counters(rows).select("label", F.col("n").cast("long").alias("n"))


@query(
    "SELECT category, label || '-' || CASE WHEN category = 'person' THEN (SELECT count(*) + 1 FROM customer) ELSE 1 END AS surrogate FROM (VALUES "
    + ", ".join(f"('{c}', '{label}')" for c, label, _ in lexicon.CATEGORIES)
    + ") t(category, label)"
)
def next_label(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(m.entry_id(F.col("c_name")).alias("id"), F.col("c_name").alias("original"), F.concat(F.lit("Person-"), (F.col("c_custkey") + 1).cast("string")).alias("surrogate"), F.lit("person").alias("category"), F.lit(True).alias("confirmed"))
    return m.next_labels(rows)


#: Every entry in turn on the text as it is by then; the second field counts surrogates after an entry that changed it.
_ENCODED = (
    _MAP + ", p AS (SELECT list([original, surrogate] ORDER BY strlen(original) DESC, original) AS pairs FROM s), "
    "enc AS (SELECT doc_id, list_reduce(list_prepend([text, '0'], (SELECT pairs FROM p)), lambda a, x: [replace(a[1], x[1], x[2]), CASE WHEN contains(a[1], x[1]) THEN "
    "cast(cast(a[2] AS BIGINT) + (length(replace(a[1], x[1], x[2])) - length(replace(replace(a[1], x[1], x[2]), x[2], ''))) // length(x[2]) AS VARCHAR) ELSE a[2] END]) AS e FROM documents)"
)


@query(_ENCODED + " SELECT doc_id, md5(e[1]) AS digest, cast(e[2] AS INTEGER) AS replacements_made FROM enc")
def encode_text(spark, sf_dir):
    return substitute.encode(_docs(spark, sf_dir), _email_map(spark, sf_dir)).select("doc_id", F.md5("text").alias("digest"), "replacements_made")


_UNIQUE = "'<<' || md5(original) || '>>'"


@query(_ENCODED.replace("'Email-' || row_number() OVER (ORDER BY k)", _UNIQUE) + " SELECT doc_id, true AS same, md5(text) AS digest, cast(e[2] AS INTEGER) AS replacements_made FROM enc JOIN documents USING (doc_id)")
def decode_round_trip(spark, sf_dir):
    """Encoded documents decoded again, by surrogates that no text holds: the first text, and as many replacements as surrogates."""
    items = _email_items(spark, sf_dir).withColumn("surrogate", F.concat(F.lit("<<"), F.md5("original"), F.lit(">>")))
    grown = written(m.add_bulk(m.empty(spark), items), "emails")
    docs = _docs(spark, sf_dir).withColumn("before", F.col("text"))
    there = written(substitute.encode(docs, grown).drop("replacements_made"), "encoded")
    return substitute.decode(there, grown).select("doc_id", F.expr("text = before").alias("same"), F.md5("text").alias("digest"), "replacements_made")


@query(
    _MAP + ", t AS (SELECT doc_id, original, surrogate, string_split(text, original) AS pieces FROM documents, s WHERE contains(text, original)), "
    "u AS (SELECT *, unnest(range(1, len(pieces))) AS k FROM t) "
    "SELECT doc_id, cast(pos AS INTEGER) AS start, cast(pos + strlen(original) AS INTEGER) AS \"end\", original AS term, surrogate AS replacement FROM (SELECT *, list_sum(list_transform(pieces[1:k], lambda x: strlen(x))) + (k - 1) * strlen(original) AS pos FROM u)"
)
def preview_spans(spark, sf_dir):
    """Every place of every mapped address in the documents, in bytes."""
    grown = _email_map(spark, sf_dir)
    return substitute.preview(_docs(spark, sf_dir), grown).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.term", "s.replacement")


@query()
def highlight_spans(spark, sf_dir):
    grown = _email_map(spark, sf_dir)
    return substitute.highlight(_docs(spark, sf_dir), grown).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.term")


@query(
    "WITH p AS (SELECT DISTINCT cast(quality AS VARCHAR) AS category, cast(doc_id AS VARCHAR) AS text FROM labels WHERE doc_id % 3 > 0), g AS (SELECT cast(quality AS VARCHAR) AS category, cast(doc_id AS VARCHAR) AS text FROM labels WHERE doc_id % 2 = 0), "
    "c AS (SELECT (SELECT count(*) FROM g SEMI JOIN p USING (category, text)) AS tp, (SELECT count(*) FROM labels WHERE doc_id % 3 > 0) AS p, (SELECT count(*) FROM g) AS g), "
    "x AS (SELECT tp, greatest(p - tp, 0) AS fp, greatest(g - tp, 0) AS fn, tp / p AS precision, tp / g AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f1 FROM x"
)
def eval_prf1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("category"), F.col("doc_id").cast("string").alias("text"), "doc_id")
    return ev.evaluate(rows.filter("doc_id % 3 > 0"), rows.filter("doc_id % 2 = 0"))


@query()
def pipeline_e2e(spark, sf_dir):
    """Detect, map and encode documents."""
    encoded, _ = pseudonymize(_docs(spark, sf_dir))
    return encoded.select("doc_id", F.size("entities").alias("n_entities"), "replacements_made", F.md5("text").alias("digest"))
