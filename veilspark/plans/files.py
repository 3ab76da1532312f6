"""Queries over files and models: Word files and workbooks made from the tables by the tasks, written, read and copied; mappings
saved and loaded; tokens of a word model over all documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..operators import mapping as m
from ..operators import ner, resolve
from ..sources import documents as files
from ..storage import new_folder
from .pipeline import spread
from .queries import query, table

_WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _folder(spark, tag: str) -> str:
    """A new folder that is there, below the shared one."""
    folder = new_folder(spark, tag)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    return folder


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts.items():
            z.writestr(name, part)
    return out.getvalue()


# --- Word files ----------------------------------------------------------------------------------------------------------


def _letters(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A Word file a supplier: runs with tabs and breaks, kept and trimmed space, entities, empty paragraphs, a table, headers."""
    p = lambda inner: f"<w:p>{inner}</w:p>"
    r = lambda inner: f"<w:r>{inner}</w:r>"
    t = lambda text: f"<w:t>{text}</w:t>"
    for frame in frames:
        made = []
        for key, name in zip(frame["s_suppkey"], frame["s_name"], strict=True):
            cell = lambda *texts: f"<w:tc>{''.join(p(r(t(x))) for x in texts)}</w:tc>"
            body = p(r(t(f"  {name} ")) + r(f'<w:tab/><w:t xml:space="preserve"> {key} </w:t><w:br/>{t("&amp;lt;b&amp;gt; &quot;x&quot;")}'))
            body += p("") * (key % 5) + "<w:p/>" + p("<w:tab/>" + r(t("nach")))
            body += f"<w:tbl><w:tr>{cell('a', 'b')}{cell(name)}</w:tr><w:tr>{cell('c')}{cell('')}</w:tr></w:tbl>"
            header = lambda kind, text: f"<w:{kind} {_WORD}>{p(r(t(text)))}</w:{kind}>"
            parts = {"word/footer1.xml": header("ftr", f"Seite {key}"), "word/document.xml": f"<w:document {_WORD}><w:body>{body}</w:body></w:document>", "word/header1.xml": header("hdr", name), "word/header2.xml": header("hdr", f"{name} zwei"), "word/header3.xml": header("hdr", " ")}
            made.append(_archive(parts))
        yield pd.DataFrame({"target": frame["target"], "data": made})


def _written_letters(spark, sf_dir, folder: str):
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{folder}/"), "s_suppkey", F.lit(".docx")).alias("target"), "s_suppkey", "s_name")
    return files.write_copies(rows.mapInPandas(_letters, "target string, data binary"))


def _letter_sql(name: str) -> str:
    """A letter's text with ``name`` in the parts that copies rewrite; the second header isn't one."""
    blank = "repeat(chr(10), least(s_suppkey % 5, 2))"
    return (
        f"{name} || chr(9) || ' ' || s_suppkey || ' ' || chr(10) || '<b> \"x\"' || chr(10) || {blank} || 'nach' || chr(10) || 'a' || chr(10) || 'b' || chr(9) || {name} || chr(10) || 'c' || chr(9) || chr(10)"
        f" || repeat(chr(10), 2) || 'Seite ' || s_suppkey || chr(10) || {name} || chr(10) || s_name || ' zwei'"
    )


_RENAMED = "replace(s_name, 'Supplier', 'Firma')"


def _key(name: str):
    """The number that a file is called by."""
    return F.regexp_extract("source_path", "/([0-9]+)[^/]*$", 1).cast("long").alias(name)


@query(f"SELECT s_suppkey, 'docx' AS format, {_letter_sql('s_name')} AS content, NULL::VARCHAR AS error FROM supplier")
def word_texts(spark, sf_dir):
    """A Word file a supplier, read: paragraphs, tabs, breaks, space, entities, blank lines, tables, headers and footers."""
    folder = _folder(spark, "letters")
    return files.read_documents(spark, _written_letters(spark, sf_dir, folder), strict=False).select(_key("s_suppkey"), "format", "content", "error")


@query(f"SELECT s_suppkey, {_letter_sql(_RENAMED)} AS content FROM supplier")
def word_copies(spark, sf_dir):
    """Copies of Word files with a term replaced: document, first header and first footer change, other parts don't."""
    folder, target = _folder(spark, "letters"), _folder(spark, "copies")
    made = files.copies(spark, _written_letters(spark, sf_dir, folder), [("Supplier", "Firma")])
    written = files.write_copies(made.select(F.regexp_replace("target", "^.*/", f"{target}/").alias("target"), "data"))
    return files.read_documents(spark, written).select(_key("s_suppkey"), "content")


# --- workbooks -----------------------------------------------------------------------------------------------------------


def _workbook(frame: pd.DataFrame) -> pd.DataFrame:
    """A workbook of some orders: text, a number, a flag, a date and an error in each row, a gap, and a second, empty sheet."""
    rows = []
    for at, o in enumerate(frame.sort_values("o_orderkey").itertuples(index=False)):
        cells = f'<c r="B{at + 1}" t="s"><v>{at % 2}</v></c><c r="C{at + 1}"><v>{o.o_custkey}</v></c><c r="E{at + 1}"><v>{o.half!r}</v></c><c r="F{at + 1}" t="b"><v>{int(o.o_orderkey % 3 == 0)}</v></c><c r="G{at + 1}" s="1"><v>{o.day}</v></c>'
        rows.append(f"<row>{cells}</row>" + ('<row/><row><c t="e"><v>#N/A</v></c></row>' if o.o_orderkey % 7 == 0 else ""))
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{_SHEET}" xmlns:r="{_RELATIONS}"><sheets><sheet name="Orders" r:id="a"/><sheet name="Leer" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{_SHEET}"><si><t>even</t></si><si><r><t>od</t></r><r><t>d</t></r></si></sst>',
        "xl/styles.xml": f'<styleSheet xmlns="{_SHEET}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_SHEET}"><sheetData>{"".join(rows)}</sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{_SHEET}"><sheetData/></worksheet>',
    }
    return pd.DataFrame({"target": frame["target"].iloc[:1], "data": [_archive(parts)]})


#: Orders of one workbook.
_BOOK = 500


def _cells_sql(day: str) -> str:
    row = f"chr(9) || CASE WHEN n % 2 = 0 THEN 'even' ELSE 'odd' END || chr(9) || o_custkey || chr(9) || chr(9) || (o_orderkey % 9) || '.5' || chr(9) || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || chr(9) || {day} || chr(10)"
    return (
        f"WITH o AS (SELECT *, o_orderkey // {_BOOK} AS book, row_number() OVER (PARTITION BY o_orderkey // {_BOOK} ORDER BY o_orderkey) - 1 AS n FROM orders) "
        f"SELECT book, 'xlsx' AS format, '=== Sheet: Orders ===' || chr(10) || string_agg({row} || CASE WHEN o_orderkey % 7 = 0 THEN '#ERR:#N/A' || repeat(chr(9), 6) || chr(10) ELSE '' END, '' ORDER BY o_orderkey) "
        "|| chr(10) || '=== Sheet: Leer ===' || chr(10) || chr(10) AS content FROM o GROUP BY book"
    )


def _books(spark, sf_dir, dates: bool):
    folder = _folder(spark, "books")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr("cast(o_orderkey % 9 AS double) + 0.5D AS half"), F.datediff("o_orderdate", F.lit("1899-12-30")).alias("day"), F.concat(F.lit(f"{folder}/"), F.expr(f"o_orderkey DIV {_BOOK}"), F.lit(".xlsx")).alias("target"))
    books = files.write_copies(rows.groupBy("target").applyInPandas(_workbook, "target string, data binary"))
    return files.read_documents(spark, books, dates=dates).select(_key("book"), "format", "content")


@query(_cells_sql("date_diff('day', DATE '1899-12-30', cast(o_orderdate AS DATE))"))
def workbook_texts(spark, sf_dir):
    """Workbooks of 500 orders each, read: shared and rich text, numbers, flags, errors, gaps, empty rows and sheets; days as numbers."""
    return _books(spark, sf_dir, False)


@query(_cells_sql("strftime(o_orderdate, '%Y-%m-%d')"))
def workbook_dates(spark, sf_dir):
    """The same workbooks with their days as dates."""
    return _books(spark, sf_dir, True)


# --- texts and mappings in files -----------------------------------------------------------------------------------------


@query("SELECT doc_id, coalesce(text, '') AS content, 'txt' AS format FROM documents")
def texts_written(spark, sf_dir):
    """Every document as a file of its own, read again."""
    folder = _folder(spark, "texts")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit(f"{folder}/"), "doc_id", F.lit(".txt")).alias("target"), "text")
    return files.read_documents(spark, files.write_texts(rows)).select(_key("doc_id"), "content", "format")


@query(
    "WITH e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) ELSE s_name END AS original FROM supplier UNION ALL SELECT s_suppkey + 1000000000, lower(s_name) FROM supplier WHERE s_suppkey % 3 = 0) "
    "SELECT min_by(original, lpad(cast(s_suppkey AS VARCHAR), 12, '0')) AS original, min(lpad(cast(s_suppkey AS VARCHAR), 12, '0')) AS id, min(s_suppkey) % 2 = 0 AS confirmed, 'Firma-' || min(s_suppkey) AS surrogate FROM e GROUP BY lower(original)"
)
def mapping_saved(spark, sf_dir):
    """A mapping of suppliers, saved as JSON and loaded on a first start: of originals that differ in case the least id stays."""
    names = table(spark, sf_dir, "supplier")
    one = names.select("s_suppkey", F.expr("CASE WHEN s_suppkey % 4 = 1 THEN upper(s_name) ELSE s_name END").alias("original"))
    two = names.filter("s_suppkey % 3 = 0").select(F.expr("s_suppkey + 1000000000").alias("s_suppkey"), F.lower("s_name").alias("original"))
    entry = one.unionByName(two).select(F.lpad(F.col("s_suppkey").cast("string"), 12, "0").alias("id"), "original", F.concat(F.lit("Firma-"), "s_suppkey").alias("surrogate"), F.lit("firma").alias("category"), F.expr("s_suppkey % 2 = 0").alias("confirmed"))
    path = new_folder(spark, "saved")
    m.save(entry, path)
    return m.load_or_empty(spark, path).select("original", "id", "confirmed", "surrogate")


@query(f"SELECT p_partkey, concat('in.put/', p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '.DOCX' ELSE '.pdf' END) AS path FROM part WHERE p_partkey % 3 = 1 AND NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 3 = 1 AND q.p_partkey < part.p_partkey)")
def first_readable(spark, sf_dir):
    """Of all paths the first that can be read."""
    paths = table(spark, sf_dir, "part").select("p_partkey", F.expr("concat('in.put/', p_partkey, CASE WHEN p_partkey % 3 = 1 THEN '.DOCX' ELSE '.pdf' END)").alias("path"))
    return files.first_supported(paths, "p_partkey")


# --- tokens of a model ---------------------------------------------------------------------------------------------------

#: Words of the tables' texts by label, for a model that knows words only.
_WORDS = {"B-PER": ["The", "Le", "Die", "A"], "I-PER": ["Orre", "of", "Of", "de"], "B-LOC": ["In", "in", "On"], "I-LOC": ["la", "La", "der", "Der"], "I-ORG": ["and", "And", "to"]}
_LABELED = "CASE " + " ".join(f"WHEN w IN ({', '.join(repr(x) for x in words)}) THEN '{label}'" for label, words in _WORDS.items()) + " ELSE 'O' END"
_TOKENS = (
    "WITH t AS (SELECT doc_id, regexp_extract_all(text, '[ \\t\\n\\r]+|[^ \\t\\n\\r]+') AS x FROM documents WHERE text IS NOT NULL), "
    "u AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM t), "
    "v AS (SELECT doc_id, w, i, sum(strlen(w)) OVER (PARTITION BY doc_id ORDER BY i) - strlen(w) AS s FROM u), "
    f"k AS (SELECT doc_id, {_LABELED} AS label, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s, s + strlen(w) AS e FROM v WHERE NOT regexp_matches(w, '^[ \\t\\n\\r]')) "
)


@query(_TOKENS + f"SELECT doc_id, label, count(*) AS n, sum(pos) AS places, sum(s) AS starts, sum(e) AS ends FROM k WHERE pos < {ner.MAX_TOKENS} GROUP BY doc_id, label")
def ner_tokens(spark, sf_dir):
    """Labels of the first 512 words of every document by a model of words, run in batches: how many, and where they stand."""
    tokens = ner.tokens_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), model=ner.word_model(_WORDS))
    return tokens.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("pos").alias("places"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))


@query(
    _TOKENS + ", c AS (SELECT *, CASE right(label, 3) WHEN 'PER' THEN 'person' WHEN 'LOC' THEN 'ort' WHEN 'ORG' THEN 'firma' END AS category FROM k), "
    "r AS (SELECT *, label LIKE 'B-%' OR lag(category) OVER w IS NULL OR lag(category) OVER w <> category AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "i AS (SELECT *, sum(cast(new AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM r WHERE category IS NOT NULL) "
    'SELECT doc_id, category, min(s) AS start, max(e) AS "end", count(*) AS n_tokens FROM i GROUP BY doc_id, run, category'
)
def ner_spans(spark, sf_dir):
    """Spans of whole documents, read in windows of 512 words that share 128, from the same model."""
    tokens = ner.tokens_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), model=ner.word_model(_WORDS), overlap=128, outside=False)
    return ner.merge_tokens(tokens).select("doc_id", "category", "start", "end", "n_tokens")


# --- pruning after merging -----------------------------------------------------------------------------------------------


@query(
    "WITH c AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey % 60 AS s, l_partkey % 60 + l_suppkey % 29 + 1 AS e, l_suppkey % 5 AS occ FROM lineitem), "
    "k AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.l_orderkey = c.l_orderkey AND d.i < c.i AND d.s <= c.s AND d.e >= c.e)) "
    "SELECT l_orderkey, string_agg('q' || lpad(cast(i AS VARCHAR), 6, '0') || ':' || s || '-' || e || '/' || occ, ' ' ORDER BY occ DESC, i) AS entities FROM k GROUP BY l_orderkey"
)
def contained_pruned(spark, sf_dir):
    """Entities of an order's lines without spans inside those of earlier ones, by occurrences before pruning."""
    ordered = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    span = "array(named_struct('s', cast(y.l_partkey % 60 AS int), 'e', cast(y.l_partkey % 60 + y.l_suppkey % 29 + 1 AS int)))"
    one = f"cast(named_struct('p', 8, 'cat', 'firma', 't', concat('q', lpad(i + 1, 6, '0')), 'conf', 0.9D, 'src', 'rule', 'occ', cast(y.l_suppkey % 5 AS int), 'offs', {span}, 'review', false, 'feats', cast(map() AS map<string, string>)) AS {resolve.CANDIDATE})"
    rows = ordered.select("l_orderkey", F.expr(f"transform(x, (y, i) -> {one})").alias("cc")).select("l_orderkey", F.expr(resolve.merge_sql("cc")).alias("m"))
    return rows.select("l_orderkey", F.expr("array_join(transform(m, c -> concat(c.f.t, ':', c.offs[0].s, '-', c.offs[0].e, '/', c.occ)), ' ')").alias("entities"))
