"""Scalar functions over text as SQL snippets and columns; all run in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon
from .spans import let

#: A Unicode letter or digit, as regular expression.
ALNUM = r"[\p{IsAlphabetic}\p{N}]"


def quoted(text: str) -> str:
    """An SQL string literal without escapes."""
    if "'" not in text:
        return f"r'{text}'"
    return 'r"' + text + '"' if '"' not in text else "concat(" + ", \"'\", ".join(quoted(p) for p in text.split("'")) + ")"


def branched(values: Sequence[str]) -> str:
    """Regular expression of words, the first that fits, in branches by first letter (in any case): those that begin otherwise
    exclude each other, so their order among each other tells nothing."""
    escaped = lambda v: re.escape(v).replace("\\ ", " ").replace("\\-", "-")
    if not all(values):
        return "|".join(map(escaped, values))
    begun: dict[str, list[str]] = {}
    for v in values:
        begun.setdefault(v[0].upper().lower(), []).append(v)
    # Those of one letter that are written alike share it.
    some = [f"{escaped(g[0][0])}(?:{'|'.join(escaped(v[1:]) for v in g)})" if len({v[0] for v in g}) == 1 and len(g) > 1 else "|".join(map(escaped, g)) for g in begun.values()]
    return "|".join(some) or "(?!)"


def holds(column: str, values: Sequence[str]) -> str:
    """SQL: whether any of the values stands in a text, without a pattern."""
    return "(" + (" OR ".join(f"contains({column}, {quoted(v)})" for v in values) or "false") + ")"


#: Characters that patterns in any case take only for those of which they are the lower case, and for the odd ones.
_PLAIN, _ODD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 -.&äöüßóéèáàâêôç"), "\u017f\u0131\u0130"


def may_hold(values: Sequence[str]) -> str:
    """SQL over text and low (the text in lower case): whether any of the values may match in any case. True of a text that holds a
    letter which a pattern in any case takes for a plain one but lower case leaves as it is, and where a value isn't plain."""
    short = sorted({v.lower() for v in values})
    if not all(_PLAIN.issuperset(v) for v in short):
        return "true"
    short = [v for v in short if not any(w != v and w in v for w in short)]  # what holds a word holds the words inside it
    return f"({holds('low', short)} OR {holds('text', _ODD)})"


def words_in(values: list[str]) -> str:
    """SQL: the words as a constant array: one literal that is split when the query is planned, where it can be."""
    if values and not any(set(v) & set("|'\\") for v in values):
        return f"split('{'|'.join(values)}', '[|]')"
    return "array(" + ", ".join(quoted(v) for v in values) + ")"


def tokens(text: str) -> str:
    """Blank-delimited tokens (Unicode white space)."""
    # split compiles its pattern at each call unless it is one plain character; regexp_replace keeps it.
    return rf"filter(split(regexp_replace({text}, r'(?U)\s+', ' '), ' ', -1), __w -> __w <> '')"


def gaps(text: str, pattern: str) -> str:
    """SQL: what stands between the (nonempty) matches of a pattern, as split gives it, without compiling it at each call."""
    mark = "chr(1)"
    return f"CASE WHEN contains({text}, {mark}) THEN split({text}, {pattern}, -1) ELSE split(regexp_replace({text}, {pattern}, {mark}), {mark}, -1) END"


def trimmed(word: str) -> str:
    return f"btrim({word}, '.,;')"


def iban_valid(text: str) -> str:
    """Check sum modulo 97 of the letters and digits: 15 to 34 of them, the first two letters."""
    compact = f"regexp_replace(upper({text}), '[^A-Z0-9]', '')"
    moved = f"concat(substring({compact}, 5), substring({compact}, 1, 4))"
    rest = "CASE WHEN __c BETWEEN '0' AND '9' THEN (__r * 10 + ascii(__c) - 48) % 97 ELSE (__r * 100 + ascii(__c) - 55) % 97 END"
    return f"({compact} rlike '^[A-Z]{{2}}[A-Z0-9]{{13,32}}$' AND aggregate(filter(split({moved}, ''), __c -> __c <> ''), 0, (__r, __c) -> {rest}) = 1)"


def year(text: str) -> str:
    """The year of two digits (from 31 on the last century's) or more."""
    n = "try_cast(__year AS int)"
    return let("__year", text, f"CASE WHEN octet_length(__year) = 2 THEN {n} + CASE WHEN {n} <= 30 THEN 2000 ELSE 1900 END ELSE {n} END")


def month(name: str) -> str:
    """1 to 12 of a German or English month name in any case."""
    return "CASE " + " ".join(f"WHEN lower({name}) IN ({', '.join(quoted(n) for n in names)}) THEN {i + 1}" for i, names in enumerate(lexicon.MONTHS)) + " END"


def date_valid(day: str, month_no: str, year_no: str) -> str:
    """In the calendar, between 1900 and 2030."""
    leap = "__date.y % 4 = 0 AND (__date.y % 100 <> 0 OR __date.y % 400 = 0)"
    days = f"CASE WHEN __date.m IN (4, 6, 9, 11) THEN 30 WHEN __date.m <> 2 THEN 31 WHEN {leap} THEN 29 ELSE 28 END"
    valid = f"coalesce(__date.y BETWEEN 1900 AND 2030 AND __date.m BETWEEN 1 AND 12 AND __date.d BETWEEN 1 AND {days}, false)"
    return let("__date", f"named_struct('d', {day}, 'm', {month_no}, 'y', {year_no})", valid)


#: Bytes before a place in which its last eight words are looked for first.
NEAR_BYTES = 400


def last_words(data: str, end: str) -> str:
    """Text that has the last eight blank-delimited tokens of the first ``end`` bytes of a text, given as binary: that of the
    bytes just before, and all of it where these hold too few."""
    from_ = f"greatest({end} - {NEAR_BYTES}, 0)"
    near = f"make_valid_utf8(cast(substring({data}, {from_} + 1, {end} - {from_}) AS string))"
    return f"CASE WHEN {end} <= {NEAR_BYTES} OR size({tokens(near)}) > 8 THEN {near} ELSE cast(substring({data}, 1, {end}) AS string) END"


def last_bytes(data: str, end: str) -> str:
    """The hundred bytes before a place, from the character boundary at or before them."""
    from_ = f"greatest({end} - 100, 0)"
    middle = lambda k: f"hex(substring({data}, {from_} - {k} + 1, 1)) BETWEEN '80' AND 'BF'"
    back = f"CASE WHEN {from_} = 0 OR NOT {middle(0)} THEN 0 WHEN NOT {middle(1)} THEN 1 WHEN NOT {middle(2)} THEN 2 ELSE 3 END"
    return f"cast(substring({data}, {from_} - {back} + 1, {end} - {from_} + {back}) AS string)"


def birth_context(before: str) -> str:
    """Whether the last eight words before a date tell that it is one of birth."""
    return let("__v", tokens(before), f"lower(array_join(slice(__v, greatest(size(__v) - 7, 1), 8), ' ')) rlike {quoted(lexicon.BIRTH_CUES)}")


def phone_plausible(text: str) -> str:
    digits = f"regexp_count({text}, '[0-9]')"
    return (
        rf"(NOT btrim({text}) rlike r'^\d{{1,2}}[./\-]\d{{1,2}}[./\-]\d{{2,4}}$' AND {digits} BETWEEN 6 AND 15 "
        rf"AND (NOT {text} rlike r'(?U)^[0-9\s]*$' OR {digits} >= 10 OR regexp_replace({text}, r'(?U)\s', '') rlike '^(015|016|017|0137)'))"
    )


def phone_confidence(before: str) -> str:
    """0.92 if one of the cues stands in what ``last_bytes`` gives, else 0.84."""
    return f"CASE WHEN {before} <> '' AND {holds(f'lower({before})', lexicon.PHONE_CUES)} THEN 0.92D ELSE 0.84D END"


def normalized(text: str) -> str:
    """Lower-cased letters and digits: what makes two entities' texts the same."""
    return rf"regexp_replace(lower({text}), r'[^\p{{IsAlphabetic}}\p{{N}}]', '')"


def is_title(word: str) -> str:
    w = f"lower({trimmed(word)})"
    return f"({w} IN ({', '.join(quoted(t) for t in lexicon.TITLES)}) OR startswith({w}, 'dr.') OR startswith({w}, 'prof.') OR {w} = 'dipl.-ing' OR startswith({w}, 'dipl.-ing.'))"


def identity(text: str) -> str:
    """A person's key: lower-cased tokens without leading titles."""
    step = f"CASE WHEN size(__a) = 0 AND {is_title('__k')} THEN __a ELSE concat(__a, array(lower({trimmed('__k')}))) END"
    return f"array_join(aggregate({tokens(text)}, cast(array() AS array<string>), (__a, __k) -> {step}), ' ')"


def titled(text: str) -> str:
    return f"coalesce({is_title(f'get({tokens(text)}, 0)')}, false)"


def first_substantive(words: str) -> str:
    """The first token that is no particle."""
    return f"get(filter(transform({words}, __w -> {trimmed('__w')}), __w -> NOT array_contains({words_in(lexicon.PARTICLES)}, lower(__w))), 0)"


def known_first_name(token: str, names: str) -> str:
    return f"coalesce(array_contains({names}, {trimmed(token)}) OR arrays_overlap({names}, transform(split({trimmed(token)}, '-'), __p -> btrim(__p))), false)"


def tail_trimmed(words: str) -> str:
    """Tokens without the office and role words at the end; at least one stays."""
    tail = words_in(sorted(set(lexicon.TAIL_WORDS + lexicon.ROLE_WORDS)))
    keep = f"CASE WHEN size(__a) = 0 AND __s.i < size({words}) - 1 AND array_contains({tail}, {trimmed('__s.x')}) THEN __a ELSE concat(__a, array(__s.x)) END"
    return f"reverse(aggregate(transform(reverse({words}), (__w, __j) -> named_struct('x', __w, 'i', __j)), cast(array() AS array<string>), (__a, __s) -> {keep}))"


def occurrences(text: str | Column, pattern: str | Column) -> Column:
    """Non-overlapping literal occurrences; none of an empty pattern."""
    text, pattern = (F.expr(x) if isinstance(x, str) else x for x in (text, pattern))
    gone = F.length(text) - F.length(F.replace(text, pattern, F.lit("")))
    return F.when(F.length(pattern) > 0, (gone / F.length(pattern)).cast("int")).otherwise(F.lit(0))


def decoded_entities(text: Column) -> Column:
    """Entities of XML text, one after the other, the ampersand first."""
    for old, new in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#xD;", ""), ("&#xA;", "\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html_escaped(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text
