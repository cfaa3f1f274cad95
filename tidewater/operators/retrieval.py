"""Text and vector retrieval: channels that score documents for a query, and what combines them.

A corpus is a DataFrame with an id and a text; a channel returns (id, score) rows. Orders are total: score descending,
then id. What a channel cannot represent (an empty document) is absent, not zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as fx


def postings(corpus: DataFrame, id_col: str, text_col: str, least: int = 2) -> DataFrame:
    """(id, term, tf): the inverted index in long form."""
    return corpus.select(id_col, F.explode(fx.tokens(F.col(text_col), least)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def top(scored: DataFrame, k: int, *ties: str, score: str = "score", least: float | None = None) -> DataFrame:
    """The k best rows above ``least``, ties by the given columns; a sort that keeps k rows per task."""
    rows = scored if least is None else scored.where(F.col(score) > least)
    return rows.orderBy(F.desc(score), *ties).limit(k)


VOCABULARY = 5000


def vocabulary(index: DataFrame, n_docs: Column, id_col: str, size: int = VOCABULARY) -> DataFrame:
    """The ``size`` most frequent terms (ties by term) with smoothed idf: at most ``size`` rows, so it may be broadcast."""
    kept = index.groupBy("term").agg(F.sum("tf").alias("total"), F.countDistinct(id_col).alias("df")).orderBy(F.desc("total"), "term").limit(size)
    return kept.select("term", "df", (F.ln((n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"))


def tfidf(index: DataFrame, n: int, query: DataFrame, id_col: str, query_col: str, size: int = VOCABULARY) -> DataFrame:
    """Cosine of raw-tf tf-idf vectors over a bounded vocabulary, from an inverted index (id, term, tf) of ``n`` documents,
    token-less ones too; ``query`` has one row."""
    n = F.lit(n)
    terms = F.broadcast(vocabulary(index, n, id_col, size))
    weights = index.join(terms, "term").select(id_col, "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked = query.select(F.explode(fx.tokens(F.col(query_col), 2)).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    asked = asked.join(terms, "term").select("term", (F.col("tf") * F.col("idf")).alias("qw"))
    unit = asked.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    scored = weights.join(F.broadcast(asked), "term", "left").groupBy(id_col).agg(F.sum(F.col("w") * F.coalesce("qw", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return scored.where("dot > 0").join(F.broadcast(unit)).select(id_col, F.round(F.col("dot") / F.col("norm") / F.col("qn"), 6).alias("score"))


def keyword(corpus: DataFrame, query: DataFrame, id_col: str, text_col: str, query_col: str) -> DataFrame:
    """Share of the distinct query tokens that occur as substrings."""
    asked = query.select(F.array_distinct(fx.tokens(F.col(query_col))).alias("asked")).first()["asked"]
    # one flag per word over one lower-cased column: plain codegen, nothing is computed per array element
    found = reduce(Column.__add__, (F.contains("_low", F.lit(t)).cast("int") for t in asked), F.lit(0))
    low = corpus.select(id_col, F.lower(F.col(text_col)).alias("_low"))
    return low.select(id_col, F.round(found / len(asked), 6).alias("score"))


def overlap(corpus: DataFrame, query: DataFrame, id_col: str, text_col: str, query_col: str) -> DataFrame:
    """|Q and D| / |Q| on folded token sets; a document without tokens is ``unrepresentable`` and has no score."""
    asked = F.broadcast(query.select(F.array_distinct(fx.tokens(fx.fold(F.col(query_col)))).alias("asked")))
    own = F.array_distinct(fx.tokens(fx.fold(F.col(text_col))))
    rows = corpus.join(asked).select(id_col, own.alias("own"), "asked")
    score = F.round(F.size(F.array_intersect("own", "asked")) / F.size("asked"), 6)
    empty = F.size("own") == 0
    return rows.select(id_col, F.when(empty, "unrepresentable").otherwise("scored").alias("status"), F.when(~empty, score).alias("score"))


def like(corpus: DataFrame, words: list[str], text_col: str) -> DataFrame:
    """Rows that contain every word, case ignored; a constant score."""
    return corpus.where(reduce(Column.__and__, (F.contains(F.lower(F.col(text_col)), F.lit(w.lower())) for w in words)))


def regex_channel(corpus: DataFrame, patterns: list[str], id_col: str, text_col: str, mode: str = "pattern_hits") -> DataFrame:
    """``any``, ``all``: 1 or 0; ``pattern_hits``: patterns found; ``match_count``: matches in all."""
    found = [F.regexp_like(F.col(text_col), F.lit(p)).cast("int") for p in patterns]
    total = reduce(Column.__add__, found)
    score = {"any": (total > 0).cast("int"), "all": (total == len(patterns)).cast("int"), "pattern_hits": total}.get(mode)
    if mode == "match_count":
        score = reduce(Column.__add__, (F.regexp_count(F.col(text_col), F.lit(p)) for p in patterns))
    return corpus.select(id_col, score.cast("double").alias("score"))


def embedding(vectors: DataFrame, query: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Cosine with one query vector, which is broadcast as one row."""
    asked = F.broadcast(query.select(F.col(vector_col).alias("asked")))
    return vectors.join(asked).select(id_col, F.round(fx.cosine(F.col(vector_col), F.col("asked")), 6).alias("score"))


def ranked(channel: DataFrame, name: str, id_col: str) -> DataFrame:
    """A channel's bounded result with ranks."""
    return channel.select(F.lit(name).alias("channel"), id_col, "score", F.row_number().over(Window.orderBy(F.desc("score"), id_col)).alias("rank"))


def fuse(channels: list[DataFrame], weights: dict[str, float], id_col: str, how: str = "rrf", constant: int = 60) -> DataFrame:
    """Combine ranked channels: ``rrf``, or ``sum``, ``max``, ``min``, ``mean`` of weighted scores; mean divides by the
    channels that hold the id."""
    union = reduce(DataFrame.unionByName, channels)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("channel"))
    signal = weight / (constant + F.col("rank")) if how == "rrf" else weight * F.col("score")
    agg = {"rrf": F.sum, "sum": F.sum, "max": F.max, "min": F.min, "mean": F.avg}[how]
    return union.groupBy(id_col).agg(F.round(agg(signal), 6).alias("score"), F.count("*").alias("channels"))


def cascade(scored: DataFrame, id_col: str, include: float = 0.75, exclude: float = 0.25) -> DataFrame:
    """Decide by levels: a mask reason excludes, the lexical band decides if it can, then the vector band, else undecided.
    A manual decision wins over all."""
    band = lambda c: F.when(F.col(c) >= include, "include").when(F.col(c) <= exclude, "exclude")
    decision = F.coalesce("manual", F.when(F.size("masks") > 0, "exclude"), band("lexical"), band("vector"), F.lit("ambiguous"))
    level = F.when(F.col("manual").isNotNull(), "manual").when(F.size("masks") > 0, "mask").when(band("lexical").isNotNull(), "lexical").when(band("vector").isNotNull(), "vector").otherwise("none")
    return scored.select(id_col, decision.alias("decision"), level.alias("level"))


def precedence(units: DataFrame, override: str, rules: list[tuple[str, Column, str]], label: str, defaults: dict[str, str]) -> DataFrame:
    """Decision of each unit: its override, else the first rule that matches, else its label's default."""
    first = reduce(lambda out, r: F.when(r[1], F.struct(F.lit(r[0]).alias("by"), F.lit(r[2]).alias("what"))).otherwise(out), reversed(rules), F.lit(None))
    default = F.element_at(F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]), F.col(label))
    return units.withColumn("_rule", first).withColumns(
        {
            "decision": F.coalesce(override, "_rule.what", default),
            "decided_by": F.when(F.col(override).isNotNull(), "override").when(F.col("_rule").isNotNull(), F.concat(F.lit("rule:"), F.col("_rule.by"))).otherwise("default"),
        }
    ).drop("_rule")


def salient(index: DataFrame, id_col: str, n_docs: int, k: int, least_df: int = 2) -> DataFrame:
    """Per document the k terms of largest (1 + ln tf) ln((n + 1) / (df + 1)), ties by term."""
    df = index.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least_df)
    weight = F.round((1 + F.ln("tf")) * F.ln((n_docs + 1.0) / (F.col("df") + 1.0)), 6)
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("weight"), "term"))
    return index.join(df, "term").withColumn("weight", weight).withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select(id_col, "rank", "term", "weight")


def expansion(index: DataFrame, hits: DataFrame, id_col: str, k: int, least: int = 3) -> DataFrame:
    """Terms that mark the hits out from the corpus: lift (df in hits / hits) / (df / n) and its damped score."""
    n, h = index.select(id_col).distinct().agg(F.count("*").alias("n")), hits.agg(F.count("*").alias("h"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    dfh = index.join(hits.select(id_col), id_col, "left_semi").groupBy("term").agg(F.count("*").alias("dfh")).where(F.col("dfh") >= least)
    rows = dfh.join(df, "term").join(F.broadcast(n)).join(F.broadcast(h))
    share = F.col("dfh") / F.col("h")
    out = rows.select("term", "dfh", "df", F.round(share / (F.col("df") / F.col("n")), 6).alias("lift"), F.round(share * F.log1p(F.col("n") / F.col("df")), 6).alias("score"))
    return top(out.where("lift > 1"), k, "term")


def centroid_scores(features: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """Leave-one-out cosine of each unit to its group's profile, from (id, group, feature, w) with unit-length rows."""
    profile = features.groupBy(group_col, "feature").agg(F.sum("w").alias("p"))
    size = profile.groupBy(group_col).agg(F.sum(F.col("p") * F.col("p")).alias("pp"))
    dot = features.join(profile, [group_col, "feature"]).groupBy(id_col, group_col).agg(F.sum(F.col("w") * F.col("p")).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("ww"))
    rest = F.sqrt(F.greatest(F.col("pp") - 2 * F.col("dot") + F.col("ww"), F.lit(0.0)))
    return dot.join(size, group_col).select(id_col, group_col, F.round(F.when(rest > 1e-9, (F.col("dot") - F.col("ww")) / (rest * F.sqrt("ww"))).otherwise(0.0), 6).alias("score"))
