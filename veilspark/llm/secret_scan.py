"""Secret scans: fixed patterns, and a pair of character Markov models, all as Spark expressions.

Patterns (kinds ``assign``, ``access``, ``hex``) give the base spans. The method adds spans of kind ``markov``: in every run
of LEAST or more token characters, the stretch whose log-likelihood ratio of a model of random strings over one of ordinary
identifiers, words and numbers is greatest, if it has STRETCH characters and its ratio exceeds a threshold. So a key inside a
long path is found, and letters or digits alone are judged like anything else. A span reaches to the next separator on both
sides; spans that overlap a base one are left out, and a run gives one span. Offsets are code points, ends exclusive.

Null text counts as empty (no spans); repeated rows are scanned each; an empty table gives no rows; other columns pass
through ``scan`` untouched (a column named ``spans`` is replaced).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns that the contract of this scan gives.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

#: What a token of the Markov models consists of; anything else ends it.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 16
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: A stretch counts as random from so many characters and this log-likelihood ratio (natural logarithm, of all of it) on.
STRETCH, THRESHOLD = 12, 10.0
#: Labelled samples of each class that default training uses.
SAMPLES = 4000

#: Parts of ordinary identifiers, for the labelled samples of that class.
PARTS = (
    "get set user name config server client value index count total default request response handler manager service "
    "factory builder context session account customer order product price payment invoice address phone number status "
    "message error warning debug trace level file path folder image video audio stream buffer reader writer parser "
    "format version update delete insert select query table column field record model view controller template "
    "layout style color width height size length offset start end begin finish first last next previous current "
    "internal external public private static final abstract interface component module package library resource "
    "the that there with tion ation ment ness able ing ered under over inter national information application "
    "language document training quality filter window batch partition shuffle broadcast checkpoint "
    "heit keit lich schaft chen nicht eine der die und auch sich ueber ver zurueck strasse geschwindigkeit bundes "
    "eux aux elle ment que pas les une pour dans avec nous etre cion mente los las para con ado ido"
).split()


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios, row by previous character (0 = start), column by character of ALPHABET."""

    ratios: tuple[float, ...]
    threshold: float = THRESHOLD


def labelled_samples(spark: SparkSession, n: int = SAMPLES, start: int = 0) -> DataFrame:
    """(text, random): by rule, ``n`` random strings (hex, base64, base62 and base32 forms) and ``n`` ordinary ones
    (identifiers, paths, words made of syllables, numbers), of ids from ``start`` on. Other ids give other samples."""
    parts = F.array(*[F.lit(p) for p in PARTS])

    def part(k: int) -> Column:
        return F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))

    def one_of(forms: list[Column]) -> Column:
        chosen = F.when(F.col("id") % len(forms) == 0, forms[0])
        for i, form in enumerate(forms[1:], 1):
            chosen = chosen.when(F.col("id") % len(forms) == i, form)
        return chosen

    words = [part(k) for k in range(4)]
    number = F.when(F.col("id") % 5 == 0, F.pmod(F.xxhash64("id"), F.lit(2100)).cast("string")).otherwise("")
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit("digits")), F.lit(10**16)).cast("string"), 16, "0")
    ordinary = one_of(
        [
            F.concat_ws("_", *words, number),
            F.concat(words[0], *[F.initcap(w) for w in words[1:]], number),
            F.concat_ws("-", *words[:3], number),
            F.concat(F.upper(words[0]), F.lit("_"), F.upper(words[1]), F.lit("/"), words[2], number),
            F.concat(*words, part(4)),
            F.initcap(F.concat(*words, part(4))),
            F.concat_ws("/", *words, part(4), F.concat_ws("-", words[0], F.substring(digits, 1, 4))),
            F.upper(F.concat(*words)),
            digits,
        ]
    )
    seed = F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256)
    coded = F.regexp_replace(F.base64(F.unhex(seed)), "\\s", "")
    plain = F.regexp_replace(coded, "[^A-Za-z0-9]", "")
    random = one_of([seed, F.upper(seed), coded, plain, F.upper(plain), F.lower(plain), F.regexp_replace(plain, "[0-9]", "")])
    ids = spark.range(start, start + n, 1, 4)
    return ids.select(ordinary.alias("text"), F.lit(False).alias("random")).unionByName(ids.select(random.alias("text"), F.lit(True).alias("random")))


def train(samples: DataFrame, threshold: float = THRESHOLD) -> MarkovPair:
    """Transition counts of both classes over (text, random), add-half smoothed. At most 2 * 68 * 67 counts reach the driver.

    Characters outside ALPHABET and null texts are left out.
    """
    width = len(ALPHABET)
    chars = samples.filter("text is not null and random is not null").select("random", F.filter(F.split("text", ""), lambda c: (c != "") & (F.instr(F.lit(ALPHABET), c) > 0)).alias("c"))
    coded = chars.select("random", F.transform("c", lambda c: F.call_function("locate", c, F.lit(ALPHABET))).alias("c"))
    steps = coded.select("random", F.explode(F.arrays_zip(F.concat(F.array(F.lit(0)), F.col("c")).alias("p"), F.col("c").alias("n"))).alias("s")).select("random", F.col("s.p").alias("p"), F.col("s.n").alias("n")).filter("n is not null")
    counts = {(r["random"], r["p"], r["n"]): r["k"] for r in steps.groupBy("random", "p", "n").agg(F.count("*").alias("k")).collect()}
    ratios = []
    for p in range(width + 1):
        total = {label: sum(counts.get((label, p, n), 0) for n in range(1, width + 1)) + 0.5 * width for label in (True, False)}
        ratios += [math.log((counts.get((True, p, n), 0) + 0.5) / total[True]) - math.log((counts.get((False, p, n), 0) + 0.5) / total[False]) for n in range(1, width + 1)]
    return MarkovPair(tuple(round(x, 4) for x in ratios), threshold)


def _spans(found: str, gaps: str, kind: int, keep: str = "true", begin: str = "0", end: str | None = None) -> str:
    """SQL: structs (s, k, e) of the matches ``found`` with the text between them in ``gaps``. ``keep``, and ``begin`` and ``end``
    of the span within its match, see i, the match's number."""
    at = f"a.pos + length({gaps}[i])"
    return f"""CASE WHEN size({found}) > 0 THEN aggregate(sequence(0, size({found}) - 1),
        named_struct('pos', 0, 'out', cast(array() AS array<struct<s: int, k: int, e: int>>)),
        (a, i) -> named_struct('pos', {at} + length({found}[i]),
            'out', CASE WHEN {keep} THEN concat(a.out, array(named_struct('s', {at} + {begin}, 'k', {kind}, 'e', {at} + {end or f'length({found}[i])'}))) ELSE a.out END),
        a -> a.out) ELSE cast(array() AS array<struct<s: int, k: int, e: int>>) END"""


def stretch_sql(tokens: str, model: MarkovPair) -> str:
    """SQL: for an array of tokens, structs (ratio, length) of each one's most random stretch, and (b, e), where that begins
    and ends once it reaches to the separators around it."""
    table = "array(" + ",".join(f"{x!r}D" for x in model.ratios) + ")"
    # The ratio of every character after the one before it (a blank, of code 0, at the start).
    steps = f"""zip_with(split(t, ''), split(concat(' ', substring(t, 1, length(t) - 1)), ''),
        (c, d) -> element_at({table}, locate(d, '{ALPHABET}') * {len(ALPHABET)} + locate(c, '{ALPHABET}')))"""
    best = f"""aggregate({steps}, named_struct('i', 0, 's', 0D, 'b', 0, 'ratio', 0D, 'from', 0, 'upto', 0),
        (a, r) -> named_struct('i', a.i + 1, 's', greatest(a.s, 0D) + r, 'b', IF(a.s > 0, a.b, a.i),
            'ratio', greatest(a.ratio, greatest(a.s, 0D) + r),
            'from', IF(greatest(a.s, 0D) + r > a.ratio, IF(a.s > 0, a.b, a.i), a.from),
            'upto', IF(greatest(a.s, 0D) + r > a.ratio, a.i + 1, a.upto)))"""
    return f"""transform(transform({tokens}, t -> named_struct('t', t, 'x', {best})), y -> named_struct('ratio', y.x.ratio, 'length', y.x.upto - y.x.from,
        'b', y.x.from - length(regexp_extract(substring(y.t, 1, y.x.from), '[^/_=-]*$', 0)),
        'e', y.x.upto + length(regexp_extract(substring(y.t, y.x.upto + 1), '^[^/_=-]*=*', 0))))"""


def scan(docs: DataFrame, model: MarkovPair, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (s, k, e) by start, then kind; k is the kind's number in KINDS."""
    esc = lambda p: "r'" + p.replace("'", "\\x27") + "'"
    p = "__scan_"
    text = f"{p}text"
    out = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "markov": CANDIDATE}
    out = out.withColumns({f"{p}{k}": F.expr(f"regexp_extract_all({text}, {esc(x)}, 0)") for k, x in patterns.items()})
    out = out.withColumns({f"{p}{k}_gaps": F.expr(f"CASE WHEN size({p}{k}) > 0 THEN split({text}, {esc(x)}, -1) END") for k, x in patterns.items()} | {f"{p}values": F.expr(f"CASE WHEN size({p}assign) > 0 THEN regexp_extract_all({text}, {esc(ASSIGN)}, 2) END")})
    base = [_spans(f"{p}assign", f"{p}assign_gaps", 0, f"length({p}values[i]) >= {ASSIGN_LEAST}"), _spans(f"{p}access", f"{p}access_gaps", 1), _spans(f"{p}hex", f"{p}hex_gaps", 2)]
    out = out.withColumn(f"{p}base", F.expr(f"array_sort(concat({', '.join(base)}))"))
    out = out.withColumn(f"{p}best", F.expr(f"CASE WHEN size({p}markov) > 0 THEN {stretch_sql(f'{p}markov', model)} END"))
    random = f"{p}best[i].ratio > {model.threshold!r}D AND {p}best[i].length >= {STRETCH}"
    out = out.withColumn(f"{p}more", F.expr(_spans(f"{p}markov", f"{p}markov_gaps", 3, random, f"{p}best[i].b", f"{p}best[i].e")))
    out = out.withColumn("spans", F.expr(f"CASE WHEN size({p}more) > 0 THEN array_sort(concat({p}base, filter({p}more, x -> NOT exists({p}base, b -> b.s < x.e AND b.e > x.s)))) ELSE {p}base END"))
    return out.drop(*[c for c in out.columns if c.startswith(p)])


def joined(spans: str, only_base: bool = False) -> Column:
    """kind:start:end of all spans, comma-joined."""
    kinds = "array(" + ",".join(f"'{k}'" for k in KINDS) + ")"
    chosen = f"filter({spans}, x -> x.k < 3)" if only_base else spans
    return F.expr(f"array_join(transform({chosen}, x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')")


def redacted(text: str, spans: str, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    fold = f"""aggregate({spans}, named_struct('pos', 0, 'out', ''),
        (a, x) -> CASE WHEN x.s >= a.pos THEN named_struct('pos', x.e, 'out', concat(a.out, substring({text}, a.pos + 1, x.s - a.pos), '{mark}'))
                  ELSE named_struct('pos', greatest(a.pos, x.e), 'out', a.out) END,
        a -> concat(a.out, substring({text}, a.pos + 1)))"""
    return F.expr(f"CASE WHEN size({spans}) > 0 THEN {fold} ELSE {text} END")
