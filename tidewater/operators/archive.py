"""Archive, catalogue and text operators: export, masks, rules, extraction, segmentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as fx


def _ordered(messages: DataFrame, key: str, order: str, line: Column, gap: str, name: str) -> DataFrame:
    listed = messages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))).alias("_m"))
    return listed.select(key, F.array_join(F.transform("_m", lambda m: m["l"]), gap).alias(name), F.size("_m").cast("long").alias("messages"))


def export_markdown(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One Markdown text per conversation, messages in order."""
    return _ordered(messages, key, order, F.concat(F.upper(role), F.lit(": "), F.col(text)), "\n\n", "markdown")


def export_lines(messages: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """One ``role: text`` line per message."""
    return _ordered(messages, key, order, F.concat(F.col(role), F.lit(": "), F.replace(F.col(text), F.lit("\n"), F.lit(" "))), "\n", "body").drop("messages")


def transcript(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Role-labelled lines back into turns."""
    label = r"^(user|assistant|system): "
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("turn", "line"))
    return lines.select(key, "turn", F.regexp_extract("line", label, 1).alias("role"), F.length(F.regexp_replace("line", label, "")).cast("long").alias("chars"))


def masked(rows: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Each row with the names of the masks that exclude it, and whether none does."""
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in masks.items()])), ",")
    return rows.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def rule(spec: dict) -> Column:
    """A rule as one condition: language, character range and pattern (case ignored) must all hold."""
    parts = [F.lit(True)]
    if "lang" in spec:
        parts.append(F.col("lang") == spec["lang"])
    if "chars" in spec:
        parts.append(F.col("n_chars").between(*spec["chars"]))
    if "pattern" in spec:
        parts.append(F.col("text").rlike(f"(?i){spec['pattern']}"))
    return reduce(Column.__and__, parts)


def event_page(events: DataFrame, after: int, kind: str, limit: int, subject: Column) -> DataFrame:
    """Events past a sequence number of an exact or ``prefix*`` type."""
    match = F.col("event_type").startswith(kind[:-1]) if kind.endswith("*") else F.col("event_type") == kind
    return events.where((F.col("event_id") > after) & match & subject).orderBy("event_id").limit(limit)


def html_text(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """Title, text between tags, and number of links."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    body = fx.squeeze(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))
    return pages.select(id_col, F.regexp_extract(html, "<title>(.*?)</title>", 1).alias("title"), body.alias("body"), F.regexp_count(html, F.lit(r"(?i)<a\s")).cast("long").alias("links"))


def entities(docs: DataFrame, patterns: dict[str, str], id_col: str, text: str) -> DataFrame:
    """(id, kind, lower-cased value) of every pattern, each once; a group in the pattern is the value."""
    def every(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), int("(" in pattern)), lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("value")))

    found = F.concat(*[every(k, p) for k, p in patterns.items()])
    return docs.select(id_col, F.explode(F.array_distinct(found)).alias("e")).select(id_col, "e.kind", "e.value")


def topics(docs: DataFrame, words: dict[str, list[str]], least: int, id_col: str, text: str) -> DataFrame:
    """Topics of which at least ``least`` words occur as substrings."""
    low = F.lower(F.col(text))
    named = [F.when(reduce(Column.__add__, [F.contains(low, F.lit(w)).cast("int") for w in ws]) >= least, F.lit(k)) for k, ws in words.items()]
    return docs.select(id_col, F.explode(F.array_compact(F.array(*named))).alias("topic"))


def relations(docs: DataFrame, pattern: str, id_col: str, text: str) -> DataFrame:
    """(id, subject, object) of each match of a pattern with two groups."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(pattern), 1).alias("subject"), F.regexp_extract_all(F.col(text), F.lit(pattern), 2).alias("object"))
    return docs.select(id_col, F.explode(pairs).alias("r")).select(id_col, F.col("r")["subject"].alias("subject"), F.col("r")["object"].alias("object"))


def language_by_stops(docs: DataFrame, stops: dict[str, list[str]], id_col: str, text: str) -> DataFrame:
    """Language with most stop-word hits; ties by the order of the table, none: unknown."""
    hits = lambda ws: F.size(F.filter("_t", lambda x: x.isin(*ws)))
    tokens = docs.select(id_col, fx.tokens(F.col(text)).alias("_t"))  # once a text, not once a language
    counts = tokens.select(id_col, *[hits(ws).alias(k) for k, ws in stops.items()])
    most = F.greatest(*stops)
    best = reduce(lambda out, k: F.when(F.col(k) == most, k).otherwise(out), reversed(list(stops)), F.lit(None))
    return counts.select(id_col, F.when(most == 0, "unknown").otherwise(best).alias("language"))


def masks(docs: DataFrame, kind: str, pattern: str, id_col: str, text: str) -> DataFrame:
    """Stable masks: distinct values of a document numbered by first appearance."""
    values = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
    numbered = docs.select(id_col, F.posexplode(values).alias("i", "value"))
    return numbered.select(id_col, "value", F.concat(F.lit(f"[{kind}#"), (F.col("i") + 1).cast("string"), F.lit("]")).alias("mask"))


def stable_id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16))


def version_key(v: Column) -> Column:
    """Dotted numbers as an array that compares like the version."""
    return F.transform(F.split(v, r"\."), lambda x: x.cast("int"))


def glob(text: Column, pattern: str) -> Column:
    """``**`` any characters, ``*`` any but ``/``, ``?`` one but ``/``."""
    import re

    parts = re.split(r"(\*\*|\*|\?)", pattern)
    return text.rlike("^" + "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts) + "$")


def trigram_pairs(names: DataFrame, name: str) -> DataFrame:
    """Jaccard similarity of the character trigrams of all pairs that share one, through an inverted index."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(F.col(name), i, 3)))
    gramed = names.where(F.length(name) >= 3).select(F.col(name).alias("_name"), grams.alias("_g"))
    listed = gramed.select(F.col("_name").alias("a"), F.size("_g").alias("na"), F.explode("_g").alias("g"))
    other = listed.select(F.col("a").alias("b"), F.col("na").alias("nb"), "g")
    shared = listed.join(other, "g").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("s"))
    return shared.select("a", "b", F.round(F.col("s") / (F.col("na") + F.col("nb") - F.col("s")), 6).alias("jaccard"))


def segments(messages: DataFrame, key: str, order: str, text: str, least: int) -> DataFrame:
    """Segments of a conversation: a turn that shares fewer than ``least`` terms with the one before starts a new one."""
    w = Window.partitionBy(key).orderBy(order)
    rows = messages.select(key, order, F.array_distinct(fx.tokens(F.col(text), 4)).alias("t")).withColumn("before", F.lag("t").over(w))
    new = F.when(F.col("before").isNull() | (F.size(F.array_intersect("t", "before")) < least), 1).otherwise(0)
    numbered = rows.withColumn("new", new).withColumn("segment", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "segment").agg(F.min(order).alias("first"), F.max(order).alias("last"))


def recognise(docs: DataFrame, rules: list[tuple[str, str, float]], id_col: str, text: str) -> DataFrame:
    """Layout of largest softmax share over summed rule weights."""
    layouts = list(dict.fromkeys(r[0] for r in rules))
    score = lambda k: reduce(Column.__add__, [F.when(F.col(text).rlike(p), F.lit(w)).otherwise(0.0) for n, p, w in rules if n == k])
    scored = docs.select(id_col, F.array(*[F.struct(F.exp(score(k)).alias("e"), F.lit(k).alias("layout")) for k in layouts]).alias("s"))
    best = F.array_max("s")
    return scored.select(id_col, best["layout"].alias("layout"), F.round(best["e"] / F.aggregate("s", F.lit(0.0), lambda a, x: a + x["e"]), 6).alias("share"))
