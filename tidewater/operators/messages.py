"""Messages: chat text to turns, unit masks, work blocks by interleaving, rare shared terms, grains, masks with check digits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels that begin a turn and the roles they stand for.
ROLE_LABELS = {"user": "user", "human": "user", "you": "user", "me": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "model": "assistant", "system": "system"}
LABEL = r"(?i)^\s*(?:#{1,6}\s*|\*\*|__)?(" + "|".join(ROLE_LABELS) + r")\s*(?:\*\*|__)?\s*:\s*(?:\*\*|__)?\s*|(?i)^\s*#{1,6}\s*(" + "|".join(ROLE_LABELS) + r")\s*$"


def chat_turns(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """Turns of a chat kept as text: (id, turn, role, text). A line with a role label (``User:``, ``**AI:**``, ``## Assistant``) begins a
    turn; lines before the first label are of role ``unknown``."""
    lines = texts.select(id_col, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    label = F.lower(F.coalesce(F.nullif(F.regexp_extract("line", LABEL, 1), F.lit("")), F.nullif(F.regexp_extract("line", LABEL, 2), F.lit(""))))
    by = Window.partitionBy(id_col).orderBy("p")
    known = lines.withColumn("label", label).withColumn("turn", F.count("label").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.when(F.col("label").isNotNull(), F.regexp_replace("line", LABEL, "")).otherwise(F.col("line"))
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_LABELS.items() for x in kv]), F.max("label")), F.lit("unknown"))
    turns = known.withColumn("line", body).groupBy(id_col, "turn").agg(role.alias("role"), F.regexp_replace(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]), "\n"), r"^\s+|\s+$", "").alias("text"))
    return turns.where("text <> ''")


def unit_masks(spec: dict) -> dict[str, Column]:
    """Conditions that exclude a unit, by name, from a specification; what it doesn't name excludes nothing. Units have lang, source,
    title, n_chars, n_messages, n_user, created, has_code, has_attachment, n_words, platform, selected. Dates have a tolerance
    of 14 hours, as time zones may be unknown."""
    c, tolerance = F.col, F.expr("INTERVAL 14 HOURS")
    makers = {
        "languages": lambda v: ~c("lang").isin(v), "not_languages": lambda v: c("lang").isin(v), "sources": lambda v: ~c("source").isin(v), "not_sources": lambda v: c("source").isin(v),
        "platforms": lambda v: ~c("platform").isin(v), "least_chars": lambda v: c("n_chars") < v, "most_chars": lambda v: c("n_chars") > v, "least_messages": lambda v: c("n_messages") < v,
        "most_messages": lambda v: c("n_messages") > v, "least_user_messages": lambda v: c("n_user") < v, "least_words": lambda v: c("n_words") < v,
        "created_from": lambda v: c("created") < F.lit(v).cast("timestamp_ntz") - tolerance, "created_to": lambda v: c("created") > F.lit(v).cast("timestamp_ntz") + tolerance,
        "title_matches": lambda v: ~c("title").rlike(f"(?i){v}"), "title_lacks": lambda v: c("title").rlike(f"(?i){v}"), "code": lambda v: c("has_code") != F.lit(v),
        "attachment": lambda v: c("has_attachment") != F.lit(v), "selected": lambda v: c("selected") != F.lit(v),
    }
    unknown = set(spec) - set(makers)
    if unknown:
        raise ValueError(f"no masks {sorted(unknown)}; there are {sorted(makers)}")
    return {name: F.coalesce(makers[name](v), F.lit(False)) for name, v in spec.items()}


def interleaved_blocks(events: DataFrame, key: str, order: str, at: str, kind: str, pause: float, switches: int) -> DataFrame:
    """Work blocks: stretches without a pause of more than ``pause`` seconds; a kind is a member if it occurs in two runs or more, or
    lies between two runs of another kind (the same before and after); blocks with more than ``switches`` changes between
    members' runs: (key, block, events, runs, members, switches)."""
    by = Window.partitionBy(key).orderBy(at, order)
    cut = events.withColumn("_b", F.sum(F.when(F.col(at) - F.lag(at).over(by) <= pause, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "_b").orderBy(at, order)
    run = F.sum(F.when(F.lag(kind).over(inside) == F.col(kind), 0).otherwise(1)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut.withColumn("_r", run).groupBy(key, "_b", "_r", kind).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(key, "_b").orderBy("_r")
    between = F.lag(kind).over(along) == F.lead(kind).over(along)
    marked = runs.withColumn("_s", F.coalesce(between, F.lit(False))).withColumn("_k", F.count("*").over(Window.partitionBy(key, "_b", kind))).withColumn("_any", F.max("_s").over(Window.partitionBy(key, "_b", kind)))
    member = marked.withColumn("_m", (F.col("_k") >= 2) | F.col("_any"))
    kept = member.where("_m").withColumn("_change", F.when(F.lag(kind).over(along) != F.col(kind), 1).otherwise(0))
    out = kept.groupBy(key, "_b").agg(F.sum("_n").alias("events"), F.count("*").alias("runs"), F.countDistinct(kind).alias("members"), F.sum("_change").alias("switches"))
    return out.where(F.col("switches") > switches).withColumnRenamed("_b", "block")


def rare_links(terms: DataFrame, id_col: str, group: str, least: int) -> DataFrame:
    """Links between documents of a group that share ``least`` or more rare terms: idf = ln(1 + (N - df + 0.5) / (df + 0.5)) above ln(N / 20),
    so a rare term is in about 20 documents at most, whatever their number; strength is the number by ten, 1 at most."""
    known = terms.select(id_col, group, "term").distinct()
    n = float(known.select(id_col).distinct().count())
    floor = F.lit(0.0) if n <= 20 else F.ln(F.lit(n / 20))
    df = known.groupBy("term").agg(F.count("*").alias("df"))
    rare = known.join(df.where(F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5)) > floor).select("term"), "term")
    pairs = rare.select(group, "term", F.col(id_col).alias("i")).join(rare.select(group, "term", F.col(id_col).alias("j")), [group, "term"]).where("i < j")
    return pairs.groupBy("i", "j").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).withColumn("strength", F.least(F.lit(1.0), F.col("shared") / 10))


def grains(messages: DataFrame, key: str, place: str, text: str, size: int, step: int) -> DataFrame:
    """A conversation at several grains: each message, windows of ``size`` every ``step`` messages with one for the tail, and the whole:
    (key, grain, first, last, chars)."""
    slim = messages.select(key, F.col(place).alias("_p"), F.length(text).alias("_c"))
    one = slim.select(key, F.lit("message").alias("grain"), F.col("_p").alias("first"), F.col("_p").alias("last"), F.col("_c").cast("long").alias("chars"))
    n = slim.groupBy(key).agg(F.count("*").alias("_n"), F.max("_p").alias("_last"), F.min("_p").alias("_first"), F.sum("_c").alias("_all"))
    whole = n.select(key, F.lit("conversation").alias("grain"), F.col("_first").alias("first"), F.col("_last").alias("last"), F.col("_all").alias("chars"))
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(F.col("_n") - size, F.lit(0)), F.lit(step)), F.array(F.greatest(F.col("_n") - size, F.lit(0)))))
    windows = n.select(key, F.explode(starts).alias("_s"))
    numbered = slim.withColumn("_i", F.row_number().over(Window.partitionBy(key).orderBy("_p")) - 1)
    held = windows.join(numbered, key).where((F.col("_i") >= F.col("_s")) & (F.col("_i") < F.col("_s") + size))
    window = held.groupBy(key, "_s").agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.sum("_c").alias("chars")).select(key, F.lit("window").alias("grain"), "first", "last", "chars")
    return one.unionByName(whole).unionByName(window)


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right check digit by the doubling rule."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda x: x.cast("int"))
    part = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)))
    return F.aggregate(part, F.lit(0), lambda s, x: s + x) % 10 == 0


def weighted_check(digits: Column, weights: list[int], modulus: int = 10) -> Column:
    """Whether the last digit completes the weighted sum of the others to a multiple of ``modulus``."""
    total = reduce(Column.__add__, (F.substring(digits, k + 1, 1).cast("int") * w for k, w in enumerate(weights)))
    return (F.length(digits) == len(weights) + 1) & (F.pmod(modulus - F.pmod(total, F.lit(modulus)), F.lit(modulus)) == F.substring(digits, len(weights) + 1, 1).cast("int"))


def checked_masks(docs: DataFrame, id_col: str, text: str, rules: list[tuple[str, str, object]], words: dict[str, str]) -> DataFrame:
    """What redaction would mask: (id, kind, value, mask). Rules are (kind, pattern, check of the digits or None); dictionary words are
    masked by their kind. Values of a document are numbered per kind by first appearance, so a value always has one mask."""
    source = F.col(text)
    parts = []
    for kind, pattern, check in rules:
        found = F.regexp_extract_all(source, F.lit(pattern), 0)
        parts.append(_spans(found if check is None else _right(found, check), kind, source))
    for word, kind in words.items():
        parts.append(_spans(F.when(F.contains(source, F.lit(word)), F.array(F.lit(word))).otherwise(F.array().cast("array<string>")), kind, source))
    spans = docs.select(id_col, F.explode(F.array_distinct(F.concat(*parts))).alias("s")).select(id_col, "s.*")
    number = F.row_number().over(Window.partitionBy(id_col, "kind").orderBy("at", "value"))
    return spans.select(id_col, "kind", "value", F.concat(F.lit("["), "kind", F.lit("#"), number.cast("string"), F.lit("]")).alias("mask"))


def _right(values: Column, check) -> Column:
    return F.filter(values, lambda v: check(F.regexp_replace(v, "[^0-9]", "")))


def _spans(values: Column, kind: str, source: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.position(v, source).alias("at"), F.lit(kind).alias("kind"), v.alias("value")))
