"""Text as columns: accents, normal forms, trigrams, similarity."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

BEYOND_ASCII = "[^\\x00-\\x7F]"
#: Hangul syllables decompose into letters by arithmetic; they stay whole here, as no normal form keeps either.
HANGUL = range(0xAC00, 0xD7A4)
#: White space of texts: the Unicode property and the four separators of ASCII; and what of it ASCII texts can hold.
BLANKS = r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
ASCII_BLANKS = r"[\x09-\x0D\x1C-\x20]+"


def _table(fold: Callable[[str], str]) -> tuple[str, str, dict[str, str], str]:
    """Over all code points but surrogates and Hangul syllables, what ``fold`` changes: characters that become one other,
    these others, those that become several, and a regular expression of those that vanish."""
    one, longer, gone = [], {}, []
    for k in range(0x110000):
        if 0xD800 <= k < 0xE000 or k in HANGUL:
            continue
        c = chr(k)
        to = fold(c)
        if to == c:
            continue
        if len(to) == 1:
            one.append((c, to))
        elif to:
            longer[c] = to
        else:
            gone.append(c)
    return "".join(a for a, _ in one), "".join(b for _, b in one), longer, _class(gone)


def _class(chars: Iterable[str]) -> str:
    """A character class of runs of code points beyond ASCII; ASCII characters fail it at the first look."""
    runs: list[list[int]] = []
    for k in sorted(map(ord, chars)):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return f"[{BEYOND_ASCII}&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]]"


def _spelled(c: Column, longer: dict[str, str]) -> Column:
    """With the characters of ``longer`` replaced, in the texts that hold one: what lies between them stays in one piece."""
    held = _class(longer)
    spelled = F.transform(F.regexp_extract_all(c, F.lit(f"({held})")), lambda x: F.from_json(F.lit(json.dumps(longer)), "map<string,string>")[x])
    joined = F.zip_with(F.split(c, held, -1), F.concat(spelled, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(c.rlike(held), F.array_join(joined, "")).otherwise(c)


ACCENTED, PLAIN, LIGATURES, MARKS = _table(lambda c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)))
CASED, CASELESS, SHARP, _ = _table(str.casefold)
#: Boilerplate of buyer names: legal forms and kinds of authority. Fixed values.
BUYER_PHRASES = (
    "commune de", "commune d", "ville de", "ville d", "departement de", "departement du", "departement d",
    "conseil departemental", "conseil regional", "region", "communaute d agglomeration", "communaute de communes",
    "communaute urbaine", "metropole", "syndicat", "etablissement public", "centre hospitalier", "chu", "ch",
    "mairie de", "mairie d", "sa", "sas", "sarl", "sasu", "eurl", "spa", "nv", "bv", "cvba", "asbl", "vzw",
)


def strip_accents(c: Column) -> Column:
    """D-01. Compatibility decomposition (NFKD) without combining marks: letters without accents, ligatures, square and
    full-width forms as plain letters; characters that don't decompose (ø, ß, œ) stay."""
    plain = lambda x: F.when(x.rlike(BEYOND_ASCII), F.regexp_replace(_spelled(x, LIGATURES), MARKS, "")).otherwise(x)
    # Most texts are ASCII, and most others once single letters are translated. In a lambda these are bound once.
    translated = F.transform(F.array(F.translate(c, ACCENTED, PLAIN)), plain)
    return F.when(c.rlike(BEYOND_ASCII), F.get(translated, F.lit(0))).otherwise(c)


def casefolded(c: Column) -> Column:
    """Full case folding: lower case, sharp s as ss, final sigma as sigma and their like."""
    return F.when(c.rlike(BEYOND_ASCII), F.translate(_spelled(c, SHARP), CASED, CASELESS)).otherwise(F.lower(c))


def collapsed(c: Column) -> Column:
    """White space of any kind as one blank, trimmed, without regard to case."""
    ascii_ = F.lower(F.trim(F.regexp_replace(c, ASCII_BLANKS, " ")))
    other = F.transform(F.array(F.trim(F.regexp_replace(c, BLANKS, " "))), casefolded)  # in a lambda it is bound once
    return F.when(c.rlike(BEYOND_ASCII), F.get(other, F.lit(0))).otherwise(ascii_)


def normalize_text(c: Column) -> Column:
    """D-02. Lower case without accents, runs of anything but a-z and 0-9 as one blank, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def normalize_buyer(c: Column) -> Column:
    """D-03. The normal form without boilerplate phrases at its ends; a name that is a phrase is kept.

    Passes over the phrases are made until one changes nothing. Each but the last takes three characters or more, so that
    a third of the length bounds them.
    """
    phrases = F.array(*[F.lit(p) for p in BUYER_PHRASES])

    def strip_one(name, phrase):
        led = F.when(name.startswith(F.concat(phrase, F.lit(" "))), F.substring(name, F.length(phrase) + 2, F.length(name))).otherwise(name)
        ended = led.endswith(F.concat(F.lit(" "), phrase))
        return F.when(name == phrase, name).when(ended, F.substring(led, F.lit(1), F.length(led) - F.length(phrase) - 1)).otherwise(led)

    def one_pass(state, _):
        after = F.aggregate(phrases, state["name"], strip_one)
        moved = F.transform(F.array(after), lambda x: F.struct(x.alias("name"), (x != state["name"]).alias("more")))
        return F.when(state["more"], F.get(moved, F.lit(0))).otherwise(state)

    base = F.transform(F.array(normalize_text(c)), lambda t: F.aggregate(F.sequence(F.lit(0), F.floor(F.length(t) / 3).cast("int")), F.struct(t.alias("name"), F.lit(True).alias("more")), one_pass, lambda s: s["name"]))
    return F.get(base, F.lit(0))


def trigrams(c: Column) -> Column:
    """D-04. Distinct three-character pieces of the normal form, padded once with two blanks before and one after."""
    letters = F.filter(F.split(F.concat(F.lit("  "), normalize_text(c), F.lit(" ")), ""), lambda x: x != "")

    def pieces(x):
        return F.array_distinct(F.transform(F.slice(x, F.lit(1), F.size(x) - 2), lambda v, i: F.concat(v, F.get(x, i + 1), F.get(x, i + 2))))

    # In a lambda the letters are bound once, not computed for every piece.
    return F.get(F.transform(F.array(letters), lambda x: F.when(F.size(x) == 3, F.array().cast("array<string>")).otherwise(pieces(x))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """D-05. Shared over all elements of two distinct arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def cosine(a: Column, b: Column) -> Column:
    """D-06. Cosine in [-1, 1]; 0 for null, unequal lengths or a zero vector."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def starts_with_any(code: Column, prefixes: Column) -> Column:
    """F-01. Whether a code lies under one of the families; a family's trailing stars are dropped, blanks ignored."""
    return F.exists(prefixes, lambda p: (p != "") & code.startswith(F.rtrim(p, F.lit("*"))))


def under_or_over_any(code: Column, zones: Column) -> Column:
    """F-02. Whether a code lies under one of the zones or a zone under it."""
    return F.exists(zones, lambda z: (z != "") & (code.startswith(z) | z.startswith(code)))


def holds_any(text: Column, words: Column) -> Column:
    """Whether a normal form holds one of the words, given in normal form, anywhere."""
    return F.exists(words, lambda w: F.contains(text, w))
