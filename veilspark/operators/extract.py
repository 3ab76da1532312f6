"""Rules to mentions: every match of a rule with its place, as expressions over one document's text.

Matches and the text between them come from two scans of one pattern (three where a group is taken), the second only if
there is a match. Running sums of their lengths give places and line numbers; what a rule wants to know of the text before a
match is read from the bytes just before it, and from the whole text before it only where these hold too few words. Nothing
is exploded and nothing shuffled; a gate in front of each rule spares the scans where a rule can't match.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import let, running
from ..functions.text import gaps, last_bytes, last_words, quoted, tail_trimmed, tokens
from .rules import Rule

#: A mention: text, span in bytes (s, e) and in characters (cs, ce), rule, confidence, source, newlines before it (addresses).
MENTION = "struct<t: string, s: int, e: int, cs: int, ce: int, rule: int, conf: double, src: string, ln: int>"
NO_MENTIONS = f"cast(array() AS array<{MENTION}>)"



def matches(rule: Rule, text: str, found: str) -> str:
    """SQL: array of (m, v, cs, s, ln): each match, the taken text before tests, where the match begins, and the newlines
    before it. ``found``: the matches."""
    pattern = quoted(rule.java)
    values = f"transform({found}, __m -> named_struct('m', __m, 'v', __m))"
    if rule.take not in ("whole", "name"):
        values = f"zip_with({found}, regexp_extract_all({text}, {pattern}, 1), (__m, __w) -> named_struct('m', __m, 'v', __w))"
    # There is a gap more than there are matches, behind the last.
    zipped = f"filter(zip_with({values}, {gaps(text, pattern)}, (__w, __g) -> named_struct('m', __w.m, 'v', __w.v, 'g', __g)), __z -> __z.m IS NOT NULL)"
    lines = (lambda part: f"length({part}) - length(replace({part}, chr(10), ''))") if rule.lines else (lambda part: "0")
    sizes = f"transform(__zz, __z -> named_struct('c', length(__z.g) + length(__z.m), 'b', octet_length(__z.g) + octet_length(__z.m), 'n', {lines('__z.g')} + {lines('__z.m')}))"
    sums = running(sizes, "named_struct('c', __x.c + __b.c, 'b', __x.b + __b.b, 'n', __x.n + __b.n)")
    start = "get(__ss, __i).b - octet_length(__z.m)"
    made = f"transform(__zz, (__z, __i) -> named_struct('m', __z.m, 'v', __z.v, 'cs', get(__ss, __i).c - length(__z.m), 's', {start}, 'ln', get(__ss, __i).n - ({lines('__z.m')})))"
    return let("__zz", zipped, let("__ss", sums, made))


def of_gates(text: str) -> dict[str, str]:
    """SQL of what gates know of a text, by name."""
    return {"text": text, "low": f"lower({text})", "digits": rf"{text} rlike r'\p{{Nd}}'"}


def mentions_sql(rule: Rule, text: str = "text", made: bool = False) -> str:
    """SQL: array of the rule's mentions in a text that isn't null. ``made``: what gates know is in columns __low and __digits."""
    known = of_gates(text) | ({"low": "__low", "digits": "__digits"} if made else {})
    over = lambda sql: re.sub(r"\b(text|low|digits)\b", lambda m: known[m[0]], sql)
    t = {"whole": "__x.m", "head": "__x.v", "tail": "__x.v", "inner": r"regexp_replace(__x.v, r'(?U)^\s+|\s+$', '')"}
    if rule.take == "name":  # office and role words at the end are cut, white space between the rest stays
        count = f"size({tail_trimmed(tokens('__x.m'))})"
        value = rf"regexp_extract(__x.m, concat(r'(?U)^((?:\S+\s+){{', cast({count} - 1 AS string), r'}}\S+)'), 1)"
    else:
        value = t[rule.take]
    first = {"tail": ("__x.s + octet_length(__x.m) - octet_length(__x.v)", "__x.cs + length(__x.m) - length(__x.v)")}.get(rule.take, ("__x.s", "__x.cs"))
    long = {"whole": "__y.m", "inner": "__y.m", "name": "__y.t"}.get(rule.take, "__y.v")
    taken = f"transform({matches(rule, text, '__f')}, __x -> named_struct('t', {value}, 'm', __x.m, 'v', __x.v, 's', {first[0]}, 'cs', {first[1]}, 'ln', __x.ln))"
    # A match that is taken whole is tested before places are looked for, which many texts need not then.
    early = rule.take == "whole" and rule.test != "true"
    passed = f"filter({taken}, (__y, __i) -> get(__ok, __i))" if early else f"filter({taken}, __y -> {_fill(rule.test)})" if rule.test != "true" else taken
    if rule.context:
        # The context before a match (of rules that take it whole) is read for those only that passed the test, in texts with a cue.
        context = {"words": last_words, "chars": last_bytes}[rule.context]("__bin", "__y.s")
        with_context = lambda b: f"transform({passed}, __y -> named_struct('t', __y.t, 'm', __y.m, 'v', __y.v, 's', __y.s, 'cs', __y.cs, 'b', {b}, 'ln', __y.ln))"
        passed = f"CASE WHEN {over(rule.cue)} THEN {let('__bin', f'cast({text} AS binary)', with_context(context))} ELSE {with_context(chr(39) * 2)} END"
    made = f"transform({passed}, __y -> named_struct('t', __y.t, 's', __y.s, 'e', __y.s + octet_length({long}), 'cs', __y.cs, 'ce', __y.cs + length({long}), 'rule', {rule.number}, 'conf', {_fill(rule.confidence)}, 'src', '{rule.source}', 'ln', __y.ln))"
    if early:
        tested = re.sub(r"(?<![\w.])(__t|__m)(?!\w)", "__e", rule.test)
        made = let("__ok", f"transform(__f, __e -> {tested})", f"CASE WHEN array_contains(__ok, true) THEN {made} ELSE {NO_MENTIONS} END")
    some = let("__f", f"regexp_extract_all({text}, {quoted(rule.java)}, 0)", f"CASE WHEN size(__f) > 0 THEN {made} ELSE {NO_MENTIONS} END")
    return f"CASE WHEN {over(rule.gate)} THEN {some} ELSE {NO_MENTIONS} END"


def _fill(sql: str) -> str:
    """SQL of a rule with its names bound. The lambda variables of the helpers begin with two underscores too, so whole words only."""
    for name, value in (("__before", "__y.b"), ("__t", "__y.t"), ("__m", "__y.m")):
        sql = re.sub(rf"(?<![\w.]){name}(?!\w)", value, sql)
    return sql


def mentions(rule: Rule, text: str = "text") -> Column:
    return F.expr(mentions_sql(rule, text))


def extract(docs: DataFrame, rule: Rule, text_col: str = "text", id_cols: list[str] | None = None) -> DataFrame:
    """A row a mention of one rule: ids, text, start, end (bytes), confidence. Null text has none."""
    ids = id_cols or [c for c in docs.columns if c != text_col]
    rows = docs.filter(F.col(text_col).isNotNull()).select(*ids, F.col(text_col).alias("text")).selectExpr("*", *(f"{sql} AS __{name}" for name, sql in of_gates("text").items() if name != "text"))
    # The outer form: a plain explode would have the matches computed once more, as a filter.
    out = rows.select(*ids, F.explode_outer(F.expr(mentions_sql(rule, made=True))).alias("x")).filter("x IS NOT NULL")
    return out.select(*ids, F.col("x.t").alias("mention"), F.col("x.s").alias("start"), F.col("x.e").alias("end"), F.col("x.conf").alias("confidence"))
