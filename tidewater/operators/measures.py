"""Measures and selections: duplicates with examples and totals, message-level diffs, skylines with dominators, selective
metrics, family bootstrap, learning proposals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_examples(rows: DataFrame, digest: Column, id_col: str, size: Column, examples: int = 3) -> DataFrame:
    """Groups of two or more rows of one digest: count, redundant size (all but the largest), the ``examples`` smallest ids. Only
    digests and sizes move; each group is thinned to its examples before they are listed."""
    slim = rows.select(digest.alias("digest"), F.col(id_col).alias("_id"), size.cast("long").alias("_size"))
    groups = slim.groupBy("digest").agg(F.count("*").alias("n"), (F.sum("_size") - F.max("_size")).alias("redundant")).where("n > 1")
    few = slim.join(groups.select("digest"), "digest", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("_id"))).where(F.col("_r") <= examples)
    listed = few.groupBy("digest").agg(F.array_join(F.sort_array(F.collect_list("_id")).cast("array<string>"), ",").alias("examples"))
    return groups.join(listed, "digest")


def findings(groups: DataFrame, k: int) -> DataFrame:
    """The k groups of largest redundancy, ties by digest, each with the totals over all groups."""
    total = groups.agg(F.count("*").alias("all_groups"), F.sum("redundant").alias("all_redundant"))
    return groups.orderBy(F.desc("redundant"), "digest").limit(k).join(F.broadcast(total))


def message_diff(old: DataFrame, new: DataFrame, key: str, place: str, digest: str) -> DataFrame:
    """Per conversation its state (new, removed, changed, unchanged) and how many messages were added, removed, changed and kept,
    by one full outer join on place."""
    a, b = old.select(key, place, F.col(digest).alias("_a")), new.select(key, place, F.col(digest).alias("_b"))
    count = lambda c: F.count_if(c)
    out = a.join(b, [key, place], "full_outer").groupBy(key).agg(
        count(F.col("_a").isNull()).alias("added"), count(F.col("_b").isNull()).alias("removed"), count(F.col("_a") != F.col("_b")).alias("changed"), count(F.col("_a") == F.col("_b")).alias("kept")
    )
    n = F.col("added") + F.col("removed") + F.col("changed") + F.col("kept")
    state = F.when(F.col("added") == n, "new").when(F.col("removed") == n, "removed").when(F.col("kept") == n, "unchanged").otherwise("changed")
    return out.withColumn("state", state)


def dominators(rows: DataFrame, group: str, id_col: str, criteria: list[str], examples: int = 3) -> DataFrame:
    """Rows of each group with how many distinct points dominate them (at least as good in every criterion, better in one) and the
    smallest ids of such points. Equal points are one in the comparison, and only points that nothing dominates are compared
    with: what a dominated point dominates, one of those does too."""
    points = rows.groupBy(group, *criteria).agg(F.min(id_col).alias("_id"))
    other = points.select(F.col(group).alias("_g"), F.col("_id").alias("_by"), *[F.col(c).alias(f"_o_{c}") for c in criteria])
    better = reduce(Column.__and__, (F.col(f"_o_{c}") >= F.col(c) for c in criteria)) & reduce(Column.__or__, (F.col(f"_o_{c}") > F.col(c) for c in criteria))
    front = points.join(other, (F.col(group) == F.col("_g")) & better, "left_anti")
    front = front.select(F.col(group).alias("_g"), F.col("_id").alias("_by"), *[F.col(c).alias(f"_o_{c}") for c in criteria])
    beaten = points.join(front, (F.col(group) == F.col("_g")) & better).groupBy(group, *criteria).agg(F.count("*").alias("dominators"), F.slice(F.sort_array(F.collect_list("_by")), 1, examples).alias("_few"))
    joined = rows.join(beaten, [group, *criteria], "left")
    return joined.select(group, id_col, *criteria, F.coalesce("dominators", F.lit(0).cast("long")).alias("dominators"), F.array_join(F.coalesce("_few", F.array()).cast("array<string>"), ",").alias("by"))


def selective(rows: DataFrame, truth: str, score: str, low: float, high: float, *by: str) -> DataFrame:
    """Metrics where only scores at ``high`` or above count as yes and at ``low`` or below as no; what lies between and what is
    missing isn't answered, and coverage is over all rows. Empty denominators give NULL."""
    yes, no = F.col(score) >= high, F.col(score) <= low
    n = lambda c: F.count_if(c)
    out = rows.groupBy(*by).agg(n((F.col(truth) == 1) & yes).alias("tp"), n((F.col(truth) == 0) & yes).alias("fp"), n((F.col(truth) == 0) & no).alias("tn"), n((F.col(truth) == 1) & no).alias("fn"), F.count("*").alias("planned"))
    answered = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.select(*by, "tp", "fp", "tn", "fn", F.round(F.try_divide(answered, F.col("planned")), 6).alias("coverage"), F.round(F.try_divide(F.col("tp") + F.col("tn"), answered), 6).alias("accuracy"))


def family_bootstrap(rows: DataFrame, family: str, a: str, b: str, replicates: int, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean paired difference where whole families are drawn: families are summed first, then each gets a
    Poisson(1) weight per replicate from a hash."""
    sums = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(family).agg(F.sum(F.col(a) - F.col(b)).alias("_d"), F.count("*").alias("_n"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(family), F.col("r")), F.lit(1_000_000)) / 1_000_000.0
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total, term = total + term, term / k
        weight = weight + F.when(u >= total, 1).otherwise(0)
    drawn = sums.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_d")), F.sum(F.col("_w") * F.col("_n"))).alias("m"))
    return means.agg(*[F.round(F.percentile("m", q), 6).alias(name) for name, q in (("low", 0.025), ("middle", 0.5), ("high", 0.975))])


def proposals(terms: DataFrame, id_col: str, verdict: str, least: int) -> DataFrame:
    """Terms that corrections speak for: in ``least`` or more corrected inclusions and in no exclusion (``include``), or the other way
    round (``exclude``)."""
    seen = terms.select(id_col, verdict, "term").distinct().groupBy("term").agg(F.count_if(F.col(verdict) == "include").alias("i"), F.count_if(F.col(verdict) == "exclude").alias("e"))
    what = F.when((F.col("i") >= least) & (F.col("e") == 0), "include").when((F.col("e") >= least) & (F.col("i") == 0), "exclude")
    return seen.select("term", what.alias("proposal"), F.greatest("i", "e").alias("corrections")).where(F.col("proposal").isNotNull())


def band_moves(judged: DataFrame, score: str, verdict: str) -> DataFrame:
    """Where corrections of ambiguous scores would move the bands: the least score that was included and the largest excluded."""
    return judged.agg(F.min(F.when(F.col(verdict) == "include", F.col(score))).alias("include_from"), F.max(F.when(F.col(verdict) == "exclude", F.col(score))).alias("exclude_to"))
