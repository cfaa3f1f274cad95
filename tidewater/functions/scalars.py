"""Scalars over words, phrases, JSON and sets. Word lists and rules are arguments, so no language is built in.

All are built-in Column expressions, but for canonical JSON and merge patches, which have no JVM-side form: those are Arrow
batched helpers over ``json``.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import fold, let

TOKEN = r"\p{N}*\p{L}[\p{L}\p{N}+#]*"


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits with a letter in them; a ``+`` or ``#`` after the letter belongs to the word."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def content_tokens(text: Column, stops: list[str], least: int = 3) -> Column:
    """Lower-cased runs of letters and digits, without numbers, stop words and words shorter than ``least``."""
    return let(F.array(*[F.lit(w) for w in stops]), lambda drop: F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), lambda t: (F.length(t) >= least) & ~t.rlike(r"^\p{N}+$") & ~F.array_contains(drop, t)))


def phrases(text: Column, stops: list[str], least: int = 3) -> Column:
    """Content words and pairs of different adjacent ones, parted by spaces or hyphens only; other signs end a phrase."""
    stop_set = F.array(*[F.lit(w) for w in stops])
    content = lambda t: (F.length(t) >= least) & ~t.rlike(r"^\p{N}+$") & ~F.array_contains(stop_set, t)
    runs = F.split(F.lower(text), r"[^\p{L}\p{N} \-]+")

    def of_run(run: Column) -> Column:
        words = F.filter(F.split(run, r"[ \-]+"), lambda w: w != "")
        return let(words, lambda w: F.concat(
            F.filter(w, content),
            F.filter(
                F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.when((i < F.size(w)) & content(F.get(w, i - 1)) & content(F.get(w, i)) & (F.get(w, i - 1) != F.get(w, i)), F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))),
                lambda p: p.isNotNull(),
            ),
        ))

    return F.flatten(F.transform(F.filter(runs, lambda r: F.trim(r) != ""), of_run))


@dataclass(frozen=True)
class Stemmer:
    """A light stemmer: exceptions, one rewrite of an ending, then the first suffix of the list that leaves enough.

    After a suffix of ``verbal`` the stem must hold a vowel; a doubled last consonant is undoubled (not one of ``keep_double``)
    and an ``e`` is restored after one of ``restore_e``.
    """

    rewrite: tuple[tuple[str, str], ...] = ()
    suffixes: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    verbal: tuple[str, ...] = ()
    restore_e: tuple[str, ...] = ()
    exceptions: dict[str, str] = field(default_factory=dict)
    least_word: int = 4
    least_stem: int = 3
    keep_double: str = "lsz"
    vowels: str = "aeiouy"


ENGLISH = Stemmer(
    rewrite=(("ies", "y"), ("sses", "ss")),
    suffixes=("ingly", "edly", "ing", "ed", "ly", "es", "s"),
    keep=("ss", "us", "is"),
    verbal=("ingly", "edly", "ing", "ed"),
    restore_e=("at", "bl", "iz"),
    exceptions={"data": "data", "news": "news"},
)


def stem(token: Column, rules: Stemmer = ENGLISH) -> Column:
    """The stem of a lower-cased word."""

    def strip(word: Column) -> Column:
        out = word
        for suffix in reversed(rules.suffixes):
            fits = word.endswith(suffix) & (F.length(word) - len(suffix) >= rules.least_stem)
            blocked = [k for k in rules.keep if k.endswith(suffix)]
            if blocked:
                fits = fits & ~reduce(Column.__or__, (word.endswith(k) for k in blocked))
            rest = F.substring(word, F.lit(1), F.length(word) - len(suffix))
            if suffix in rules.verbal:
                fits = fits & rest.rlike(f"[{rules.vowels}]")
                doubled = rest.rlike(f"([^{rules.vowels}{rules.keep_double}])\\1$")
                restored = reduce(Column.__or__, (rest.endswith(r) for r in rules.restore_e), F.lit(False))
                rest = F.when(doubled, F.substring(rest, F.lit(1), F.length(rest) - 1)).when(restored, F.concat(rest, F.lit("e"))).otherwise(rest)
            out = F.when(fits, rest).otherwise(out)
        return out

    rewritten = token
    for ending, to in reversed(rules.rewrite):
        fits = token.endswith(ending) & (F.length(token) - len(ending) + len(to) >= rules.least_stem)
        rewritten = F.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(ending)), F.lit(to))).otherwise(rewritten)
    known = F.create_map(*[F.lit(x) for kv in rules.exceptions.items() for x in kv]) if rules.exceptions else None
    whole = F.when(F.length(token) < rules.least_word, token).otherwise(let(rewritten, strip))
    return whole if known is None else F.coalesce(F.element_at(known, token), whole)


def match_key(token: Column, rules: Stemmer = ENGLISH) -> Column:
    """Lower-cased, stemmed and folded."""
    return let(F.lower(token), lambda t: fold(stem(t, rules)))


def phrase_key(text: Column, stops: list[str], rules: Stemmer = ENGLISH, glossary: dict[str, str] | None = None) -> Column:
    """Match keys of the words that are no stop words, joined by spaces; then glossary phrases, longest first."""
    kept = F.filter(word_tokens(text), lambda t: ~F.array_contains(F.array(*[F.lit(w) for w in stops]), t))
    out = F.array_join(F.transform(kept, lambda t: fold(stem(t, rules))), " ")
    for phrase, to in sorted((glossary or {}).items(), key=lambda kv: (-len(kv[0].split()), kv[0])):
        out = F.regexp_replace(out, rf"(?<![^ ]){re.escape(phrase)}(?![^ ])", to)
    return out


def guess_lang(text: Column, one: tuple[str, list[str], str], two: tuple[str, list[str]], least_tokens: int = 4, least: float = 0.1, mixed: float = 0.08) -> Column:
    """A language of two by shares of stop words: ``one`` is (name, stop words, letters only it has), ``two`` (name, stop
    words). Both shares at ``mixed`` or more: mixed; short texts only by their letters; else unknown."""
    (a, a_stops, cues), (b, b_stops) = one, two
    tokens = word_tokens(text)

    def judge(t: Column) -> Column:
        cue = lambda x: x.rlike(f"[{cues}]")
        n = F.size(t)
        of_a = F.size(F.filter(t, lambda x: x.isin(a_stops) | cue(x))) / n
        of_b = F.size(F.filter(t, lambda x: ~(x.isin(a_stops) | cue(x)) & x.isin(b_stops))) / n
        by_share = F.when((of_a >= mixed) & (of_b >= mixed), "mixed").when((of_a > of_b) & (of_a >= least), a).when(of_b > least, b).otherwise("unknown")
        return F.when(n == 0, "unknown").when(n < least_tokens, F.when(F.exists(t, cue), a).otherwise("unknown")).otherwise(by_share)

    return let(tokens, judge)


def clip(text: Column, n: int) -> Column:
    """At most ``n`` characters, the last an ellipsis if some were cut."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def utf8_prefix(text: Column, n: int) -> Column:
    """The longest prefix of whole characters that fits ``n`` bytes."""
    most = F.substring(text, 1, n)
    sizes = F.transform(F.sequence(F.lit(0), F.length(most)), lambda k: F.struct(F.octet_length(F.substring(most, F.lit(1), k)).alias("bytes"), k.alias("k")))
    fits = F.array_max(F.transform(F.filter(sizes, lambda s: s["bytes"] <= n), lambda s: s["k"]))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(most, F.lit(1), fits))


def phrase_pattern(phrase: str) -> str:
    """Regular expression for a phrase at word boundaries; a final ``*`` makes it a prefix, final punctuation ends itself."""
    prefix = phrase.endswith("*")
    body = phrase[:-1] if prefix else phrase
    open_end = prefix or not body[-1].isalnum()
    return rf"(?:^|[^\p{{L}}\p{{N}}_]){re.escape(body)}" + ("" if open_end else r"(?:$|[^\p{L}\p{N}_])")


def has_phrase(text: Column, phrase: str) -> Column:
    """Whether the lower-cased text holds the phrase at word boundaries."""
    return F.lower(text).rlike(phrase_pattern(phrase))


def render(template: str, values: dict[str, Column]) -> Column:
    """``{{name}}`` replaced by values; null values and unknown names become empty."""
    parts, at = [], 0
    for m in re.finditer(r"\{\{(\w+)\}\}", template):
        parts += [F.lit(template[at : m.start()]), F.coalesce(values.get(m[1], F.lit("")).cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


#: Key parts, exempt keys and value prefixes that mark secrets.
SECRET_KEYS = ("secret", "token", "password", "passwd", "apikey", "api_key", "authorization", "bearer", "credential", "private_key")
REFERENCE_KEYS = ("secret_key", "secret_ref", "credential_ref")
SECRET_PREFIXES = ("sk-", "gsk_", "ghp_", "xoxb-", "AIza", "Bearer ")


def redact_secrets(fields: Column) -> Column:
    """A string map with ``[redacted]`` under secret keys (unless they only refer to one, or hold a plain number or truth
    value) and for values of 20 bytes or more with a secret prefix."""

    def safe(key: Column, value: Column) -> Column:
        low = F.lower(key)
        named = reduce(Column.__or__, (F.contains(low, F.lit(k)) for k in SECRET_KEYS)) & ~key.isin(*REFERENCE_KEYS)
        plain = value.isNull() | value.rlike(r"^(-?[0-9]+(\.[0-9]+)?|true|false|null)$")
        looks = (F.octet_length(value) >= 20) & reduce(Column.__or__, (value.startswith(p) for p in SECRET_PREFIXES))
        return F.when((named & ~plain) | looks, F.lit("[redacted]")).otherwise(value)

    return F.transform_values(fields, safe)


def encoded_spans(text: Column, least_base64: int = 40, least_hex: int = 32) -> Column:
    """Encoded data in a text, as structs (kind, chars): data URIs, base64 runs with digits and both cases, and hex runs;
    what lies in a data URI or a base64 run isn't found again."""
    uri = r"data:[a-zA-Z0-9.+/-]*;base64,[A-Za-z0-9+/]+={0,2}"
    base = rf"[A-Za-z0-9+/]{{{least_base64},}}={{0,2}}"
    found = lambda t, p: F.regexp_extract_all(t, F.lit(p), 0)
    looks = lambda s: s.rlike("[0-9]") & s.rlike("[a-z]") & s.rlike("[A-Z]")
    as_kind = lambda kind, spans, size: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), size(s).cast("long").alias("chars")))
    without_uri = F.regexp_replace(text, uri, " ")

    def rest(t: Column) -> Column:
        bases = F.filter(found(t, base), looks)
        # mixed-case runs go before hex is looked for; lower-case hex has no upper case and stays
        hexes = found(F.regexp_replace(t, rf"(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[A-Z]){base}", " "), rf"\b(?:[0-9a-fA-F]{{2}}){{{least_hex // 2},}}\b")
        return F.concat(as_kind("base64", bases, F.length), as_kind("hex", hexes, F.length))

    return F.concat(as_kind("data_uri", found(text, uri), lambda s: F.length(F.substring_index(s, ",", -1))), let(without_uri, rest))


def pointer_escape(name: Column) -> Column:
    """A JSON pointer's member name: ``~`` as ``~0``, ``/`` as ``~1``."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def key_groups(keys: Column, groups: list[list[str]]) -> Column:
    """Whether the key array holds at least one key of every group."""
    return reduce(Column.__and__, (F.arrays_overlap(keys, F.array(*[F.lit(k) for k in g])) for g in groups), F.lit(True))


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _patched(value, patch):
    if not isinstance(patch, dict):
        return patch
    out = dict(value) if isinstance(value, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _patched(out.get(k), v)
    return out


def _difference(old, new) -> dict:
    out = {k: None for k in old if k not in new}
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(old.get(k), dict):
            if inner := _difference(old[k], v):
                out[k] = inner
        elif k not in old or old[k] != v:
            out[k] = v
    return out


def _loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def canonical_json(text: Column) -> Column:
    """The JSON with sorted keys and no spaces; null for what is no JSON."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if (v := _loads(t)) is None else _canonical(v))

    return run(text)


def merge_patch(text: Column, patch: Column) -> Column:
    """The JSON object with the patch laid over it, member by member; null members delete. Canonical."""

    @F.pandas_udf("string")
    def run(values: pd.Series, patches: pd.Series) -> pd.Series:
        return pd.Series([_canonical(_patched(_loads(v), _loads(p))) for v, p in zip(values, patches, strict=True)])

    return run(text, patch)


def patch_between(old: Column, new: Column) -> Column:
    """The smallest merge patch that turns one JSON object into another."""

    @F.pandas_udf("string")
    def run(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([_canonical(_difference(_loads(a) or {}, _loads(b) or {})) for a, b in zip(olds, news, strict=True)])

    return run(old, new)


def sentences(text: Column, abbreviations: list[str], least_words: int = 2) -> Column:
    """Sentences of prose. Code between fences is left out; headings and rules end a paragraph and are none; bullets and
    table rows are paragraphs of their own; other lines of a paragraph are joined. A sentence ends at ``.!?…`` and closing
    signs before white space and an upper-case letter or digit, unless the dot ends an abbreviation."""
    prose = F.array_join(F.filter(F.transform(F.split(text, r"(?m)^[ \t]*(?:```|~~~).*$"), lambda part, i: F.when(i % 2 == 0, part)), lambda p: p.isNotNull()), "\n\n")
    lines = F.regexp_replace(prose, r"(?m)^[ \t]*(?:#+ .*|[-|: ]{3,}|\*\*\*)$", "")
    bullets = F.regexp_replace(lines, r"(?m)^[ \t>]*(?:[-*+] |[0-9]{1,3}[.)] )", "\n\n")
    tables = F.regexp_replace(F.regexp_replace(bullets, r"(?m)^[ \t]*\|[ \t]*(.*?)[ \t]*\|?[ \t]*$", "\n\n$1\n\n"), r"[ \t]*\|[ \t]*", " — ")
    paragraphs = F.transform(F.split(tables, r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    guard = "".join(rf"(?<!\b{re.escape(a)}\.)" for a in abbreviations)
    cut = rf"(?<=[.!?…])(?<!\b\p{{L}}\.\p{{L}}\.){guard}[\"'”’)\]]*\s+(?=[\p{{Lu}}\p{{N}}\"'“(\[])"
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.split(p, cut)))
    return F.filter(pieces, lambda s: F.size(F.regexp_extract_all(s, F.lit(r"[\p{L}\p{N}]+"), 0)) >= least_words)
