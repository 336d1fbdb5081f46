"""String normalisation and spelling variants, as Column functions (JVM only)."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

def kept(build):
    """A function of column names whose expression is put together once an application for the same names.

    A large expression takes thousands of calls to the JVM, more than its analysis; it is the same for every query.
    """
    memo: dict = {}

    @functools.wraps(build)
    def told(*args):
        if not all(isinstance(a, (str, bool)) for a in args):
            return build(*args)
        spark = SparkSession.getActiveSession()
        key = (spark.sparkContext.applicationId if spark else None, args)
        if key not in memo:
            memo[key] = build(*args)
        return memo[key]

    return told


#: Minus sign, hyphen-minus and the dashes U+2010 to U+2015.
DASHES = "−-‐‑‒–—―"
DASH_CLASS = "[\\x{2212}\\x{002D}\\x{2010}-\\x{2015}]"

#: Spelled-out names of U+0391.. and U+03B1.., in code-point order; final sigma has none.
_GREEK_NAMES = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
_CODES = [c for c in range(0x3B1, 0x3CA) if c != 0x3C2]
GREEK = {chr(c - 32): n.capitalize() for c, n in zip(_CODES, _GREEK_NAMES, strict=True)} | {chr(c): n for c, n in zip(_CODES, _GREEK_NAMES, strict=True)}
GREEK_LATIN = {"alpha": "a", "Alpha": "A", "beta": "b", "Beta": "B", "gamma": "c", "Gamma": "C", "delta": "d", "Delta": "D"}
ROMAN = "I II III IV V VI VII VIII IX X".split()

#: Letters and signs without a decomposition to ASCII, and their usual ASCII spellings.
_SPELLINGS = {
    "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ł": "l", "Ł": "L", "ı": "i",
    "‘": "'", "’": "'", "‚": ",", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "•": "*", "·": "*", "×": "x", "÷": "/", "′": "'", "″": '"', "†": "+", "€": "EUR", "£": "PS", "¢": "C/", "©": "(c)", "®": "(r)", "°": "deg", "±": "+-", "¿": "?", "¡": "!", "§": "SS", "µ": "u",
}


def _decomposed() -> dict[str, str]:
    """Code points up to U+FFFD whose compatibility decomposition without marks is ASCII."""
    out = {}
    for code in range(0x80, 0xFFFE):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or c in GREEK or c in _SPELLINGS:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c).replace("⁄", "/") if not unicodedata.combining(x))
        if plain != c and plain.isascii() and (plain.strip() or plain == " "):
            out[c] = plain
        elif unicodedata.combining(c):
            out[c] = ""
    return out


TRANSLITERATION = _decomposed() | _SPELLINGS
_ONE = {k: v for k, v in TRANSLITERATION.items() if len(v) == 1}
_GONE = [k for k, v in TRANSLITERATION.items() if not v]
_MORE = {k: v for k, v in TRANSLITERATION.items() if len(v) > 1}
ONE_FROM, ONE_TO = "".join(_ONE) + "".join(_GONE), "".join(_ONE.values())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace_dashes(s, rep: str = "-") -> Column:
    """Every kind of dash becomes rep."""
    return F.regexp_replace(_col(s), DASH_CLASS, rep)


def remove_dashes(s) -> Column:
    return replace_dashes(s, "")


def replace_whitespace(s, rep: str = " ") -> Column:
    """Runs of Unicode white space become rep; ends are not trimmed."""
    return F.regexp_replace(_col(s), r"(?U)\s+", rep)


def to_ascii(s) -> Column:
    """ASCII spellings of all but Greek letters. ASCII strings, nearly all, pass by; long spellings are looked up by character."""
    s = _col(s)
    one = F.translate(s, ONE_FROM, ONE_TO)
    table = F.create_map(*[x for k, v in _MORE.items() for x in (F.lit(k), F.lit(v))])
    long = F.array_join(F.transform(F.split(one, ""), lambda c: F.coalesce(table[c], c)), "")
    return F.when(s.rlike(r"^\p{ASCII}*$"), s).otherwise(F.when(one.rlike(r"^[\p{ASCII}\p{InGreek}]*$"), one).otherwise(long))


@kept
def normalize(s) -> Column:
    """White space, then dashes (removed), then ASCII spellings, then lower case; not trimmed."""
    return F.lower(to_ascii(remove_dashes(replace_whitespace(s))))


def replace_greek_uni(s) -> Column:
    """Spelled-out Greek letters become letters, one name after the other in table order."""
    return functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[1]), F.lit(kv[0])), GREEK.items(), _col(s))


def replace_greek_latin(s) -> Column:
    return functools.reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), GREEK_LATIN.items(), _col(s))


def replace_greek_spelled_out(s) -> Column:
    """Greek letters become their names."""
    s = _col(s)
    table = F.create_map(*[F.lit(x) for kv in GREEK.items() for x in kv])
    return F.when(s.rlike(r"\p{InGreek}"), F.array_join(F.transform(F.split(s, ""), lambda c: F.coalesce(table[c], c)), "")).otherwise(s)


def split_preserve_tokens(s) -> Column:
    """Pieces between non-word characters, and these characters, empty pieces included."""
    marked = F.regexp_replace(_col(s), r"(?U)(\W)", "\u0001$1\u0001")
    return F.split(marked, "\u0001")


def capitalization(word, sentence_start: bool = False) -> Column:
    w = _col(word)
    out = F.when(w.rlike(r"^\p{Lu}\p{Ll}*$"), "sentence_initial_cap").when(w.rlike(r"^\p{Lu}$"), "single_cap_letter") if sentence_start else F.when(w.rlike(r"^\p{Lu}$"), "single_cap_letter")
    return out.when(w.rlike(r"^\p{Lu}+$"), "all_caps").when(w.rlike(r"^\p{Ll}+$"), "all_lower").when(w.rlike(r"^\p{Lu}\p{Ll}+$"), "initial_cap").otherwise("mixed")


def depluralize(word) -> Column:
    """array<struct(singular, rule)>, in the order in which the rules are tried."""
    w = _col(word)
    cut = lambda n: F.substr(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))
    one = lambda text, rule: F.struct(text.alias("singular"), F.lit(rule).alias("rule"))
    return (
        F.when(~w.endswith("s") | w.endswith("sis"), F.array(one(w, "non_plural")))
        .when(w.endswith("oes"), F.array(one(cut(2), "plural_oes"), one(cut(1), "plural_s")))
        .when(w.endswith("ies"), F.array(one(F.concat(cut(3), F.lit("y")), "plural_ies"), one(cut(1), "plural_s")))
        .when(w.rlike("(xes|ses|ches|shes)$"), F.array(one(cut(2), "plural_es"), one(cut(1), "plural_s")))
        .when(cut(1).rlike(r"^\p{Lu}+$"), F.array(one(cut(1), "plural_caps_s")))
        .otherwise(F.array(one(cut(1), "plural_s")))
    )


def roman_arabic(s) -> Column:
    """A last token I..X or 1..10 after a dash or space is exchanged with the other notation."""
    s = _col(s)
    last = F.upper(F.regexp_extract(s, r"(?i)^.*[- ](\d+|[IXV]+)$", 1))
    table = F.create_map(*[F.lit(x) for i, r in enumerate(ROMAN, 1) for x in (r, str(i), str(i), r)])
    other = table[last]
    return F.when(other.isNotNull(), F.concat(F.substr(s, F.lit(1), F.length(s) - F.length(last)), other)).otherwise(s)


@kept
def lookups(raw) -> Column:
    """The distinct normalised variants under which a string is looked up: at most eight."""
    raw = _col(raw)
    forms = F.array(raw, replace_dashes(raw, " "), replace_greek_uni(raw), replace_greek_latin(raw), replace_greek_spelled_out(raw), roman_arabic(raw))
    forms = F.concat(forms, F.transform(depluralize(raw), lambda x: x["singular"]))
    # variants are mostly equal before they are normalised
    return F.array_distinct(F.transform(F.array_distinct(forms), lambda x: normalize(x)))
