"""Text measures as Column expressions (JVM side, no Python per row but for index terms, whose many rules run once per distinct word)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordlists as wl
from .stemming import each_distinct, stem

# RE2-compatible patterns: Java and RE2 give the same matches for them.
WORD = r"[\p{L}\p{N}_]+"
WORD_APOSTROPHE = r"[\p{L}\p{N}_'’]+"
WORD_OR_PUNCT = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
SENTENCE = r"[^.!?\n]+[.!?]*"
ELISION = r"^(l|d|j|m|t|s|c|n|qu|jusqu|lorsqu|puisqu|quoiqu)['’]"

STOPWORDS = frozenset(wl.FRENCH_STOPWORDS)

# Accents removed, and what replaces them.
ACCENTED = "àâéèêëîïôöùüç"
PLAIN = "aaeeeeiioouuc"

# Label and pattern of each text property reported by textual_features.
TEXT_PROPERTIES = [
    ("WEIRD_CHARS", r"[^\w\s\p{IsLatin}\p{Punct}]"),
    ("DIGITS", r"\d"),
    ("URL", r"http.://"),
    ("QUOTE", r"(?m)^\s*\&gt"),
]


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with `value` evaluated once per row, however often fn uses it.

    Catalyst copies an expression into every place that refers to it, filters and lambdas
    included; a one-element transform keeps a costly text expression single.
    """
    return F.get(F.transform(F.array(value), lambda x: fn(x)), F.lit(0))


def strip_accents(c: Column) -> Column:
    """Remove French accents from lowercase text."""
    return F.translate(c, ACCENTED, PLAIN)


def fold(c: Column) -> Column:
    """Lowercase and accent-free."""
    return strip_accents(F.lower(c))


def normalize_term(c: Column, stop_words: list[str] = wl.FRENCH_STOPWORDS) -> Column:
    """Folded term without non-word characters; null when nothing is left or it is a stop word.

    Accents go before the stop-word test, so accented stop words stay (pass folded
    words to drop them too).
    """
    t = bare_term(c)
    return F.when((t != "") & ~t.isin(stop_words), t)


def bare_term(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^A-Za-z0-9_]", "")


def normalized_tokens(c: Column, stop_words: list[str] = wl.FRENCH_STOPWORDS) -> Column:
    """Normalised terms of a text, in order, without stop words.

    The text is folded as a whole; only tokens with an apostrophe or a letter outside ASCII
    need the pattern that strips non-word characters.
    """
    def strip(w: Column) -> Column:
        plain = (F.length(w) == F.octet_length(w)) & ~w.contains("'")
        return F.when(plain, w).otherwise(F.regexp_replace(w, "[^A-Za-z0-9_]", ""))

    tokens = F.transform(matches(fold(c), WORD_APOSTROPHE), strip)
    return F.filter(tokens, lambda t: (t != "") & ~t.isin(stop_words))


def drop_stop_words(tokens: Column, stop_words: list[str] = wl.FRENCH_STOPWORDS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(stop_words))


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def split_words(c: Column) -> Column:
    """Word tokens in order; null for null text."""
    return matches(c, WORD)


def sentences(c: Column) -> Column:
    return F.filter(matches(c, SENTENCE), lambda s: F.trim(s) != "")


def analyze_french(c: Column) -> Column:
    """Index terms: lowercase tokens, elided articles removed, stop words removed, stems of the rest. Not for use inside a lambda."""
    return index_terms(matches(F.lower(c), WORD_APOSTROPHE))


@lru_cache(1 << 18)
def index_term(token: str) -> str | None:
    """The term of a lowercase token; none for stop words and bare apostrophes. Words come again and again: the latest are remembered."""
    t = re.sub(ELISION, "", token)
    return None if not t.strip("'’") or t in STOPWORDS else stem(t)


@F.arrow_udf(T.ArrayType(T.StringType()))
def index_terms(tokens):
    """Lists of lowercase tokens -> lists of their terms."""
    return each_distinct(tokens, index_term)


def n_sentences(c: Column) -> Column:
    return F.size(sentences(c)).cast("long")


def n_words(c: Column) -> Column:
    """Number of tokens, punctuation marks included."""
    return F.size(matches(c, WORD_OR_PUNCT)).cast("long")


def take_first_and_last(xs: Column, n_first: int, n_last: int) -> Column:
    """First n_first and last n_last elements without overlap."""
    def ends(x: Column) -> Column:
        both = F.concat(F.slice(x, 1, n_first), F.slice(x, -n_last, n_last))
        return F.when(F.size(x) > n_first + n_last, both).otherwise(x)

    return bind(xs, ends)


def first_ngrams(tokens: Column, stop_at: int | None = 12, sizes=(1, 2, 3)) -> Column:
    """Distinct n-grams (joined by a space) of the first `stop_at` tokens."""
    def grams(head: Column, n: int) -> Column:
        starts = F.when(F.size(head) >= n, F.sequence(F.lit(1), F.size(head) - (n - 1)))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(head, i, n), " "))

    head = tokens if stop_at is None else F.slice(tokens, 1, stop_at)
    return bind(head, lambda h: F.array_distinct(F.concat(*[grams(h, n) for n in sizes])))


def bag_of_words(tokens: Column) -> Column:
    """Distinct tokens with their counts, array<struct<term, tf>>, computed inside the row.

    Sort, then measure the runs: n log n per text, and no shuffle of exploded tokens.
    """
    def runs(s: Column) -> Column:
        n = F.size(s)
        positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(positions, lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return bind(starts, lambda b: F.transform(b, lambda at, k: F.struct(
            F.get(s, at - 1).alias("term"),
            (F.coalesce(F.get(b, k + 1), n + 1) - at).cast("long").alias("tf"))))

    return bind(F.array_sort(tokens), runs)


def high_one_bit(n: Column) -> Column:
    """Largest power of two not above n (0 for 0)."""
    n = n.cast("long")
    shifted = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n)) - 1)
    return F.when(n == 0, F.lit(0).cast("long")).otherwise(shifted)


def textual_features(label: str, c: Column) -> Column:
    size = F.concat(F.lit(f"`{label}`->length-h1b="), high_one_bit(F.length(c)).cast("string"))
    flags = [F.when(c.rlike(rx), F.lit(f"`{label}` CONTAINS {name}")) for name, rx in TEXT_PROPERTIES]
    return F.when(c.isNotNull(), F.array_compact(F.array(size, *flags)))


def integer_features(label: str, n: Column) -> Column:
    sign = F.when(n < 0, "-").otherwise("+")
    bucket = F.concat(F.lit(f"`{label}`->h1b="), sign, high_one_bit(F.abs(n.cast("long"))).cast("string"))
    return F.when(n.isNotNull(), F.array(bucket))


def timestamp_features(label: str, epoch: Column) -> Column:
    month = F.date_format(instant_from_utc(epoch), "yyyy-MM")
    return F.when(epoch.isNotNull(), F.array(F.concat(F.lit(f"`{label}`->Y-M="), month)))


def key_features(cols: dict[str, Column]) -> Column:
    """One ``KEY `k` T/F`` per present key; F for a present but false value."""
    def feature(name, c, is_bool):
        value = F.when(c, "T").otherwise("F") if is_bool else F.lit("T")
        return F.when(c.isNotNull(), F.concat(F.lit(f"KEY `{name}` "), value))

    return F.array_compact(F.array(*[feature(n, c, b) for n, (c, b) in cols.items()]))


def map_key_features(m: Column) -> Column:
    """The same over a map column."""
    return F.transform(
        F.map_entries(m),
        lambda e: F.concat(F.lit("KEY `"), e["key"], F.when(e["value"].isNull(), "` F").otherwise("` T")),
    )


def value_feature(label: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(F.concat(F.lit(f"`{label}`="), c)))


def feature_set(*groups: Column) -> Column:
    """Distinct union of feature arrays; a null group adds nothing."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(g, empty) for g in groups]))


def clean_special_characters(c: Column) -> Column:
    return F.regexp_replace(c, SPECIAL_CHARACTERS, "")


# HTML entities and URL prefixes that are dropped from raw text.
SPECIAL_CHARACTERS = r"(\&\#x\d{3}[a-zA-Z];|https?://(www\.)?)"


def non_empty_md(c: Column) -> Column:
    """Null for missing, blank or sentinel text."""
    return F.when(~c.isin(wl.NO_TEXT) & c.rlike(r"\S"), c)


def contains_any(c: Column, literals: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(x) for x in literals])


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def instant_from_utc(epoch: Column) -> Column:
    """Epoch seconds given as a number or a string -> timestamp."""
    return F.timestamp_seconds(epoch.cast("long"))


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
