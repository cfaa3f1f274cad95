"""Text expressions: tokenizing, folding, n-grams, snippets. All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
#: What letters with diacritics fold to, each with its own target.
FOLDS = {
    "ą": "a", "ć": "c", "ę": "e", "ł": "l", "ń": "n", "ó": "o", "ś": "s", "ź": "z", "ż": "z",
    "á": "a", "à": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "ç": "c", "é": "e", "è": "e", "ê": "e", "ë": "e",
    "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ô": "o", "ö": "o", "õ": "o",
    "ú": "u", "ù": "u", "û": "u", "ü": "u", "ý": "y", "ÿ": "y", "ß": "ss", "œ": "oe", "æ": "ae",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row: inside a lambda, a plain expression would be computed per element."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of at least ``least`` letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{least},}}"), 0)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    single = {k: v for k, v in FOLDS.items() if len(v) == 1}
    out = F.translate(F.lower(text), "".join(single), "".join(single.values()))
    for letter, target in FOLDS.items():
        if len(target) > 1:
            out = F.replace(out, F.lit(letter), F.lit(target))
    return out


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def char_ngrams(text: Column, n: int) -> Column:
    """Character n-grams of the text with an underscore on both sides."""
    grams = lambda p: F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, n))
    return let(F.concat(F.lit("_"), text, F.lit("_")), grams)


def snippet(text: Column, needle: Column, around: int = 60) -> Column:
    """The text around the first hit of ``needle`` (case ignored), the hit in brackets; else the first 80 characters."""
    at = F.locate(needle, F.lower(text)) if isinstance(needle, str) else F.instr(F.lower(text), needle)
    size = F.length(needle) if not isinstance(needle, str) else F.lit(len(needle))
    begin = F.greatest(at - around, F.lit(1))
    before = F.substring(text, begin, at - begin)
    hit = F.substring(text, at, size)
    after = F.substring(text, at + size, F.lit(around))
    left = F.when(begin > 1, F.lit("...")).otherwise(F.lit(""))
    right = F.when(at + size + around <= F.length(text), F.lit("...")).otherwise(F.lit(""))
    return F.when(at > 0, F.concat(left, before, F.lit("["), hit, F.lit("]"), after, right)).otherwise(F.substring(text, 1, 80))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; 0 if either has no length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(product / (norm(a) * norm(b)))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def common_prefix(a: Column, b: Column, longest: int = 1 << 24) -> Column:
    """Number of characters that two texts share at their beginning, by halving: some 24 comparisons whatever the length. A null shares nothing."""
    steps = F.array(*[F.lit(longest >> k) for k in range(longest.bit_length())])
    same = lambda k, s: (k + s <= F.least(F.length(a), F.length(b))) & (F.substring(a, k + 1, s) == F.substring(b, k + 1, s))
    return F.aggregate(steps, F.lit(0), lambda k, s: F.when(same(k, s), k + s).otherwise(k))


def counted(items: Column) -> Column:
    """Each different item of an array with its number: array<struct<term, tf>>, sorted."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda p: F.transform(p, lambda x, j: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(p, j + 1), F.size(s)) - x).alias("tf"))))

    return F.when(F.size(items) > 0, let(F.array_sort(items), runs))
