"""Detection rules as data: pattern, what of a match is text and span, category, confidence, gate and test."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import lexicon, text

NAME = "[A-ZÄÖÜ][a-zäöüß]"
CURRENCIES = "EUR|USD|GBP|CHF|SEK|NOK|DKK|PLN|CZK|HUF"
#: White space within a line: rules that work line by line can't cross its end.
BLANK = r"[\s&&[^\n]]"


@dataclass(frozen=True)
class Rule:
    """A match's text and span: whole; head and tail: group 1 at the match's start or end; inner: group 1 trimmed as text,
    the whole match as span. ``test`` is SQL over __t (text) and __m (whole match), ``confidence`` over these and __before; ``gate``
    and ``cue`` are SQL over the document, as text and low (in lower case), and digits (whether it has any): no text that they
    leave out has a match, or a context that tells anything."""

    id: str
    number: int  # passes run in the order of number // 10
    category: str
    pattern: str
    confidence: str = "0D"
    source: str = "rule"
    take: str = "whole"
    gate: str = "true"
    test: str = "true"
    flags: str = "(?U)"
    context: str = ""  # what __before holds: the last eight words (words) or hundred bytes (chars) before the match, or nothing
    cue: str = "true"
    lines: bool = False  # whether line numbers are needed

    @property
    def java(self) -> str:
        return self.flags + self.pattern


def _date(day: str, month: str, year: str) -> str:
    return text.date_valid(f"try_cast({day} AS int)", month, text.year(year))


def _part(pattern: str, group: int) -> str:
    return f"regexp_extract(__m, {text.quoted(pattern)}, {group})"


_DMY, _SLASH, _ISO = r"(\d{1,2})\.(\d{1,2})\.(\d{2,4})", r"(\d{1,2})/(\d{1,2})/(\d{2,4})", r"(\d{4})-(\d{2})-(\d{2})"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Januar|Februar|März|Mai|Juni|Juli|Oktober|Dezember"
#: As branches of their first letters: few are tried at a place, and the same in the same order.
_BRANCHED = text.branched(_MONTHS.split("|"))
_DAY_MONTH = rf"(\d{{1,2}})\.\s?({_BRANCHED})\s*(\d{{2,4}})"
_MONTH_YEAR = rf"({_BRANCHED})\s+(\d{{4}})"
_CASELESS = "(?iU)"
_BIRTH = f"CASE WHEN __before <> '' AND {text.birth_context('__before')} THEN 0.93D ELSE 0.91D END"
_BORN, _CALLED = text.holds("low", lexicon.BIRTH_PARTS), text.holds("low", lexicon.PHONE_CUES)
_NOT_STOPPED = f"NOT arrays_overlap({text.tokens('__t')}, {text.words_in(lexicon.PERSON_STOPWORDS)}) AND {text.identity('__t')} <> ''"
# Gates know as many digits and white space as the patterns do: those of all scripts.
_DIGIT = "digits"
_SYMBOL = text.holds("text", "$€£¥")
_MONEY = text.may_hold([*CURRENCIES.split("|"), "Franke", "Pfund", "Dollar", "Pound"])
_CAPITALS = r"text rlike r'\p{Lu}{2}'"
# Parts of the months' names in any case that stand in all of them.
_MONTH = text.may_hold(["janua", "februa", "mar", "mär", "april", "may", "mai", "june", "juni", "july", "juli", "august", "september", "octob", "oktob", "novemb", "decemb", "dezemb"])


def rules(first_names: list[str] | None = None, places: list[str] | None = None, brands: list[str] | None = None) -> list[Rule]:
    """All rules in the order of passes; lists given replace the default ones."""
    names = text.words_in(list(first_names if first_names is not None else lexicon.FIRST_NAMES))
    by_length = sorted(places if places is not None else lexicon.PLACES, key=lambda p: -len(p.encode()))
    quote = text.branched
    words = text.tokens("__m")
    first = text.first_substantive(words)
    listed = f"size({words}) >= 2 AND {text.known_first_name(first, names)} AND NOT array_contains({text.words_in(lexicon.NAME_EXCLUSIONS)}, {first}) AND NOT arrays_overlap({words}, {text.words_in(lexicon.PERSON_STOPWORDS)}) AND {_NOT_STOPPED}"
    company_word, company_tail = r"[A-Za-züäöÜÄÖß\-\.]", r"[A-Za-züäöÜÄÖß\-\.&]"
    legal = r"GmbH(?:\s*&\s*Co\.?\s*KG)?|AG|SE|KG|OHG|UG(?:\s*\(haftungsbeschränkt\))?|eG|mbH|GbR|e\.V\.|e\.K\.|Ltd\.|Inc\.|Corp\."
    streets = "straße|str\\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|chaussee|promenade|brücke|berg|tal|feld|hof|markt|graben"
    return [
        Rule("email", 10, "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "0.98D", gate="contains(text, '@')", flags=_CASELESS),
        Rule("iban", 20, "iban", r"\b[A-Z]{2}\d{2}(?:[ \t]?[A-Z0-9]){11,30}\b", "0.97D", gate=_DIGIT + r" AND text rlike r'\p{L}{2}\p{Nd}{2}'", test=text.iban_valid("__t"), flags=_CASELESS),
        Rule("money_prefix_symbol", 30, "betrag", r"[$€£¥]\s?\d[\d.,]*", "0.92D", gate=_SYMBOL),
        Rule("money_suffix_symbol", 31, "betrag", r"\d[\d.,]*+\s?[$€£¥]", "0.92D", gate=_SYMBOL + r" AND text rlike r'(?U)[\d.,]\s?[$€£¥]'"),
        Rule("money_suffix_word", 32, "betrag", rf"\d[\d.,]*+\s++(?:Euro|{CURRENCIES}|Franken?|Pfund|Dollar|Pounds?)\b", "0.92D", gate=f"{_DIGIT} AND {_MONEY}", flags=_CASELESS),
        Rule("money_prefix_code", 33, "betrag", rf"\b(?:{CURRENCIES})\s+\d[\d.,]*\b", "0.92D", gate=f"{_DIGIT} AND {_MONEY}" + r" AND text rlike r'(?iU)[RDPFKN]\s+\d'", flags=_CASELESS),
        Rule("date_dot", 40, "datum", rf"\b{_DMY}\b", _BIRTH, gate=f"{_DIGIT} AND contains(text, '.')", test=_date(_part(_DMY, 1), f"try_cast({_part(_DMY, 2)} AS int)", _part(_DMY, 3)), context="words", cue=_BORN),
        Rule("date_day_month", 41, "datum", rf"\b{_DAY_MONTH}\b", _BIRTH, gate=f"{_DIGIT} AND contains(text, '.') AND {_MONTH}", test=_date(_part(_CASELESS + _DAY_MONTH, 1), text.month(_part(_CASELESS + _DAY_MONTH, 2)), _part(_CASELESS + _DAY_MONTH, 3)), flags=_CASELESS, context="words", cue=_BORN),
        Rule("date_month_year", 42, "datum", rf"\b{_MONTH_YEAR}\b", _BIRTH, gate=f"{_DIGIT} AND {_MONTH}", test=f"coalesce(try_cast({_part(_CASELESS + _MONTH_YEAR, 2)} AS int) BETWEEN 1900 AND 2030, false)", flags=_CASELESS, context="words", cue=_BORN),
        Rule("date_iso", 43, "datum", rf"\b{_ISO}\b", _BIRTH, gate=f"{_DIGIT} AND contains(text, '-')", test=text.date_valid(f"try_cast({_part(_ISO, 3)} AS int)", f"try_cast({_part(_ISO, 2)} AS int)", f"try_cast({_part(_ISO, 1)} AS int)"), context="words", cue=_BORN),
        Rule("date_slash", 44, "datum", rf"\b{_SLASH}\b", _BIRTH, gate=f"{_DIGIT} AND contains(text, '/')", test=_date(_part(_SLASH, 1), f"try_cast({_part(_SLASH, 2)} AS int)", _part(_SLASH, 3)), context="words", cue=_BORN),
        # The last group repeats possessively and ends where no word character follows: the same matches without backtracking.
        Rule("phone_grouped", 50, "telefon", r"(?:\+\d{1,3}[\s./-]?|\b\d{1,3}[\s./-]?)(?:\(\d{2,5}\)|\d{2,5})(?:[\s./-]\d++(?!\w))++", text.phone_confidence("__before"), gate=_DIGIT, test=text.phone_plausible("__t"), context="chars", cue=_CALLED),
        Rule("phone_compact", 51, "telefon", r"\b0\d{9,14}\b", text.phone_confidence("__before"), gate=_DIGIT + r" AND contains(text, '0') AND text rlike r'0\p{Nd}{9}'", test=text.phone_plausible("__t"), context="chars", cue=_CALLED),
        Rule("street", 60, "ort", rf"\b{NAME}+(?:{streets}){BLANK}*\d+{BLANK}?[a-zA-Z]?\b", "0.82D", gate=f"{_DIGIT} AND {text.holds('text', [s.replace(chr(92), '') for s in streets.split('|')])}", lines=True),
        Rule("street_preposition", 61, "ort", rf"\b(?:Am|An{BLANK}der|An{BLANK}dem|Auf{BLANK}der|Auf{BLANK}dem|Im|In{BLANK}der|In{BLANK}dem|Zum|Zur|Bei{BLANK}der|Bei{BLANK}dem){BLANK}+{NAME}+{BLANK}*\d+{BLANK}?[a-zA-Z]?\b", "0.82D", gate=f"{_DIGIT} AND {text.holds('text', ['Am', 'An', 'Auf', 'Im', 'In', 'Zum', 'Zur', 'Bei'])}", lines=True),
        Rule("postcode", 62, "ort", rf"\b(\d{{5}}){BLANK}+({NAME}+(?:-[a-zäöüß]+)?)\b", "0.85D", gate=_DIGIT + r" AND text rlike r'(?U)\d{5}\s'", test="substring(__t, 1, 5) rlike '^(?!00)[0-9]{5}$'", lines=True),
        Rule("place", 70, "ort", rf"\b(?:{quote(by_length)})\b", "0.80D", flags=_CASELESS),
        Rule("company_legal", 80, "firma", rf"\b([A-ZÜÄÖ]{company_word}*(?:\s+(?:(?:&|und|von|de)\s+)?[A-ZÜÄÖ0-9]{company_tail}*){{0,7}})\s+({legal})\b", "0.95D", gate=text.holds("text", ["GmbH", "AG", "SE", "KG", "OHG", "UG", "eG", "mbH", "GbR", "e.V.", "e.K.", "Ltd.", "Inc.", "Corp."]) + rf" AND text rlike r'(?U)\s(?:{legal})'"),
        Rule("company_signal", 81, "firma", r"\b(?:Firma|Hersteller|Partner|Lieferant|Kunde|Unternehmen)\s+([A-ZÜÄÖ][A-Za-züäöÜÄÖß0-9\-\.&]{1,50}(?:\s+[A-ZÜÄÖ][A-Za-züäöß]{1,40}){0,2})\b", "0.82D", take="tail", gate=text.holds("text", ["Firma", "Hersteller", "Partner", "Lieferant", "Kunde", "Unternehmen"])),
        Rule("company_hyphen", 82, "firma", r"\b([\p{Lu}]{2,5}-[A-Za-züäöÜÄÖß]+\.?)(?:\s|\z|[,;:\)])", "0.88D", take="head", gate=r"contains(text, '-') AND text rlike r'\p{Lu}{2}-'"),
        Rule("company_acronym", 83, "firma", r"\b([\p{Lu}]{2,5}\s+[A-ZÜÄÖ][a-züäöß]{2,40})\b", "0.86D", take="head", gate=r"text rlike r'(?U)\p{Lu}{2}\s+[A-ZÜÄÖ]'", test=f"NOT array_contains({text.words_in(lexicon.ABBREVIATION_STOPWORDS)}, get({text.tokens('__t')}, 0))"),
        Rule("person_title", 100, "person", rf"\b(?:Dr\. med\.|Prof\. Dr\.|Dipl\.-Ing\.|Ing\.|Mag\.|Dr\.|Prof\.|Herr|Frau|Herrn|Hr\.|Fr\.|Mr\.|Mrs\.|Ms\.)\s+((?:{NAME}+)(?:\s+(?:van|von|de|der|den|zum|zur)\s+)?(?:\s+{NAME}+){{0,3}})\b", "0.90D", take="tail", gate=text.holds("text", ["Dr.", "Prof.", "Ing.", "Mag.", "Herr", "Frau", "Hr.", "Fr.", "Mr.", "Mrs.", "Ms."]), test=_NOT_STOPPED),
        Rule("person_context", 101, "person", rf"\b(?:mein\s+Name\s+ist|ich\s+heiße|Ansprechpartner:\s*|Sachbearbeiter:\s*|Verfasser:\s*|gez\.)\s*({NAME}+(?:\s+{NAME}+){{0,2}})\b", "0.84D", take="tail", gate=text.holds("text", ["Name", "heiße", "Ansprechpartner", "Sachbearbeiter", "Verfasser", "gez."]), test=_NOT_STOPPED),
        Rule("person_greeting", 102, "person", rf"\bHallo\s+({NAME}+)\b", "0.82D", take="tail", gate="contains(text, 'Hallo')", test=_NOT_STOPPED),
        Rule("person_dear", 103, "person", rf"\bLiebe[rn]?\s+({NAME}+(?:\s+{NAME}+)?)\b", "0.83D", take="tail", gate="contains(text, 'Liebe')", test=_NOT_STOPPED),
        Rule("person_listed", 104, "person", r"\b([A-ZÜÄÖ][a-züäöß]{1,30})(?:\s+(?:van|von|de|der|den|zum|zur)\s+)?(?:\s+[A-ZÜÄÖ][a-züäöß]{1,30}){1,2}\b", f"CASE WHEN size({text.tokens('__t')}) >= 2 THEN 0.78D ELSE 0.72D END", "lexicon", take="name", test=listed),
        Rule("brand", 110, "produkt", rf"\b(?:{quote(brands if brands is not None else lexicon.BRANDS)})\b", "0.90D", "lexicon", flags=_CASELESS),
        Rule("product_code", 111, "produkt", r"\b[A-Z][A-Za-z]*\s?[A-Z]?\d{1,4}[a-zA-Z]?\b", "0.72D", gate=_DIGIT, test=f"octet_length(btrim(__t)) BETWEEN 2 AND 24 AND NOT array_contains({text.words_in(lexicon.NO_PRODUCT_CODES)}, btrim(__t))"),
        Rule("product_context", 112, "produkt", r"\b(?:Modell|Produkt|Typ|Gerät|Marke|Software|Version|Fahrzeug)\s+[:.]?\s*([A-ZÄÖÜ0-9][^,;.\n]{1,48})", "0.76D", take="inner", gate=text.may_hold(["Modell", "Produkt", "Typ", "Gerät", "Marke", "Software", "Version", "Fahrzeug"]), test="octet_length(__t) >= 2", flags=_CASELESS),
        Rule("quoted", 113, "produkt", r"""[„"»«]([^„"»«\n]{2,50})["»«„]""", "0.80D", take="inner", gate=text.holds("text", '„"»«'), test="__t <> ''"),
        Rule("trademark", 114, "produkt", r"\b([\w\-]{2,30})[®™]", "0.85D", take="inner", gate=text.holds("text", "®™"), test="__t <> ''"),
        Rule("abbreviation", 120, "sonstiges", r"\b([\p{Lu}]{2,5})\b", "0.65D", gate=_CAPITALS, test=f"NOT array_contains({text.words_in(lexicon.ABBREVIATION_STOPWORDS)}, __t)"),
    ]


@dataclass(frozen=True)
class Passes:
    """The rules of each pass, in order."""

    rules: tuple[Rule, ...] = field(default_factory=lambda: tuple(rules()))

    def numbers(self) -> list[int]:
        return sorted({r.number // 10 for r in self.rules})

    def of(self, number: int) -> list[Rule]:
        return [r for r in self.rules if r.number // 10 == number]

    def get(self, rule_id: str) -> Rule:
        return next(r for r in self.rules if r.id == rule_id)
