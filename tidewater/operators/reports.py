"""Deduplication, comparison and report operators: groups of equal rows, redundancy, diffs, reconciliation, metrics.

Unknown stays unknown: NULL inputs make NULL results and are named, never counted as zero.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import text as fx
from tidewater.workspace import materialize


def duplicate_groups(rows: DataFrame, digest: Column, id_col: str, size: Column, examples: int = 3) -> DataFrame:
    """Groups of two or more rows of one digest: count, redundant size (all but the largest), the first few ids.

    The digest is computed before the shuffle, so texts don't move; examples come from a bounded sorted prefix.
    """
    slim = rows.select(digest.alias("digest"), F.col(id_col).alias("_id"), size.cast("long").alias("_size"))
    agg = slim.groupBy("digest").agg(F.count("*").alias("n"), (F.sum("_size") - F.max("_size")).alias("redundant"), F.min("_id").alias("first_id"))
    return agg.where("n > 1")


def message_digest(role: str, text: str) -> Column:
    """Hash of role and white-space-normalised text."""
    return F.sha2(F.concat(F.col(role), F.lit("\u001f"), F.trim(F.regexp_replace(text, r"\s+", " "))), 256)


def conversation_digest(messages: DataFrame, key: str, order: str, digest: Column) -> DataFrame:
    """Hash of each conversation's ordered message digests."""
    listed = messages.select(key, order, digest.alias("_d")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "_d"))).alias("_l"))
    return listed.select(key, F.sha2(F.array_join(F.transform("_l", lambda x: x["_d"]), ""), 256).alias("digest"), F.size("_l").cast("long").alias("n_messages"))


def balance(rows: DataFrame, costs: list[str], benefits: list[str]) -> DataFrame:
    """Benefit minus cost where all parts are known, with the names of those that aren't."""
    parts = [*costs, *benefits]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in parts]))
    plus = lambda cs: reduce(Column.__add__, [F.col(c) for c in cs])
    return rows.withColumns({"known": F.size(missing) == 0, "missing": F.array_join(missing, ","), "balance": F.round(plus(benefits) - plus(costs), 4)})


def diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Full outer comparison by identity: new, changed, removed or unchanged."""
    a, b = old.select(key, F.col(digest).alias("_a")), new.select(key, F.col(digest).alias("_b"))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "removed").when(F.col("_a") == F.col("_b"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def reconcile(ledger: DataFrame, export: DataFrame, key: str, amount: str, tolerance: float) -> DataFrame:
    """Ledger against provider export on the exact key. Equal duplicates in the export count once, conflicting ones are
    rejected; a ledger row of unknown amount is recovered from the export."""
    one = export.groupBy(key).agg(F.count_distinct(amount).alias("_k"), F.first(amount).alias("_x"))
    both = ledger.select(key, F.col(amount).alias("_l"), F.lit(True).alias("_in")).join(one, key, "full_outer")
    state = (
        F.when(F.col("_k") > 1, "conflict")
        .when(F.col("_in").isNull(), "unmatched export")
        .when(F.col("_k").isNull(), "unmatched ledger")
        .when(F.col("_l").isNull(), "recovered")
        .when(F.abs(F.col("_l") - F.col("_x")) <= tolerance, "matched")
        .otherwise("mismatch")
    )
    return both.select(key, state.alias("state"))


def skyline(rows: DataFrame, group: str, id_col: str, criteria: list[str]) -> DataFrame:
    """Rows of each group that no other row dominates (at least as good everywhere, better somewhere; larger is better).

    Only distinct criteria points that are best for their first criterion value can dominate, so each point is compared
    with the running maxima of the points before it (two criteria), in one sorted pass per group.
    """
    x, y = criteria
    points = rows.groupBy(group, x).agg(F.max(y).alias("_best"))
    above = F.max("_best").over(Window.partitionBy(group).orderBy(F.desc(x)).rowsBetween(Window.unboundedPreceding, -1))
    kept = points.withColumn("_above", above).where(F.col("_above").isNull() | (F.col("_best") > F.col("_above")))
    return rows.join(kept, [group, x]).where(F.col(y) == F.col("_best")).select(group, id_col, *criteria)


def nearest_rank(rows: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Element floor(q (n - 1) + 0.5) of each key's sorted values, no interpolation; nulls are left out."""
    w = Window.partitionBy(key)
    ranked = rows.where(F.col(value).isNotNull()).select(key, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_r") - 1 == F.floor(q * (F.col("_n") - 1) + 0.5)).select(key, F.col(value).alias("value"))


def noisy_or(support: DataFrame, claim: str, unit: str, confidence: str) -> DataFrame:
    """1 - product of (1 - v) over units, each counted once at its best."""
    best = support.groupBy(claim, unit).agg(F.max(confidence).alias("_v"))
    sure = F.max(F.when(F.col("_v") >= 1, 1).otherwise(0)) == 1
    rest = F.exp(F.sum(F.when(F.col("_v") < 1, F.ln(1 - F.col("_v"))).otherwise(0.0)))
    return best.groupBy(claim).agg(F.when(sure, 1.0).otherwise(F.round(1 - rest, 4)).alias("confidence"), F.count("*").alias("units"))


def isotonic(x: Column, knots: list[tuple[float, float]]) -> Column:
    """Piecewise linear map through the knots, flat beyond both ends."""
    out = F.lit(knots[-1][1])
    for (a, p), (b, q) in reversed(list(zip(knots, knots[1:], strict=False))):
        out = F.when(x <= b, p + (x - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x <= knots[0][0], F.lit(knots[0][1])).otherwise(out)


def conflicts(claims: DataFrame, keys: list[str], value: str, source_rank: str, at: str, id_col: str) -> DataFrame:
    """Keys with several values of a functional predicate: the winner by source precedence, then the latest, then id."""
    agg = claims.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("claims"), F.max(F.struct(F.col(source_rank), F.col(at), F.col(id_col), F.col(value))).alias("_w"))
    return agg.where("n_values > 1").select(*keys, "n_values", "claims", F.col(f"_w.{value}").alias("winner"), F.col(f"_w.{id_col}").alias("winner_id"))


def confusion(rows: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Counts and rates; a missing answer is neither right nor wrong, an empty denominator gives NULL."""
    known = F.col(predicted).isNotNull()
    cell = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    out = rows.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn"), F.count_if(~known).alias("missing"), F.count("*").alias("planned"))
    rate = lambda a, b: F.round(F.try_divide(a, b), 6)
    recall, specificity = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tn", F.col("tn") + F.col("fp"))
    return out.withColumns(
        {"precision": rate(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.round(recall, 6), "specificity": F.round(specificity, 6),
         "balanced": F.round((recall + specificity) / 2, 6), "coverage": rate(F.col("planned") - F.col("missing"), F.col("planned"))}
    )


def bootstrap(rows: DataFrame, unit: str, a: str, b: str, replicates: int, seed: int = 7) -> DataFrame:
    """Percentile interval of the mean paired difference over complete pairs: each unit draws a Poisson(1) weight per
    replicate from a hash, so replicates are aggregates of one pass and no row is drawn by a join."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(unit, (F.col(a) - F.col(b)).alias("_d"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(unit), F.col("r")), F.lit(1_000_000)) / 1_000_000.0
    weight, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 8):
        total, term = total + term, term / k
        weight = weight + F.when(u >= total, 1).otherwise(0)
    drawn = pairs.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("_w", weight)
    means = drawn.groupBy("r").agg((F.sum(F.col("_w") * F.col("_d")) / F.sum("_w")).alias("m"))
    return means.agg(F.round(F.percentile("m", 0.025), 6).alias("low"), F.round(F.percentile("m", 0.5), 6).alias("middle"), F.round(F.percentile("m", 0.975), 6).alias("high"))


def shingle_set(text: Column, size: int, gap: str = r"\s+") -> Column:
    """Distinct word shingles of a text."""
    places = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - size + 1, F.lit(1)))
    return F.array_distinct(fx.let(F.split(F.lower(F.trim(text)), gap), lambda w: F.transform(places(w), lambda i: F.array_join(F.slice(w, i, size), " "))))


def token_sets(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Distinct word shingles in long form with the set's size."""
    grams = shingle_set(F.col(text), size)
    return docs.select(id_col, F.size(grams).alias("size"), F.explode(grams).alias("gram"))


def jaccard_classes(grams: DataFrame, id_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(links, members) of sets in long form (id, gram): links (a, b, score) of classes a < b of similarity ``least`` (above 0) or more,
    whatever the grams' frequencies, and (id, class) of every id. Equal sets are one class, named by its smallest id.

    Two sets of n and m grams are similar if they share s = ceil(least / (1 + least) (n + m)) or more. With grams in one order, rarest
    first, they then share k of the first n - s + k grams of each, for every k up to s, so they meet in a choice of k grams from
    there; k is as large as few choices allow, because choices are rarer than grams. Sizes go by bands, single ones while
    they are small. Rows without an id are in no class.
    """
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = grams.where(F.col(id_col).isNotNull()).join(df, "gram").groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("l"))
    sets = materialize(ordered.select("id", F.transform("l", lambda x: x["gram"]).alias("set")))
    classes = materialize(sets.groupBy("set").agg(F.min("id").alias("class")).withColumn("n", F.size("set")))
    return class_links(classes, least), sets.join(classes.select("set", "class"), "set").select("id", "class")


CHOICES, MOST_CHOSEN = 10, 4  # choices of a set and pair of bands where more than one gram is chosen, and grams of one


def _bands(longest: int) -> list[tuple[int, int]]:
    """(lowest, highest) sizes of bands: single sizes up to 10, then steps of a tenth."""
    out, low = [], 1
    while low <= longest:
        high = max(low, low * 11 // 10 - 1)
        out.append((low, high))
        low = high + 1
    return out


def _meetings(sizes: list[int], least: float) -> list[tuple[int, int, int, int]]:
    """(band, other band, shared, chosen): pairs of bands that hold sizes and can hold similar sets, with the grams that these share at
    least and how many of them a meeting is made of."""
    held = [(low, high) for low, high in _bands(max(sizes, default=0)) if any(low <= n <= high for n in sizes)]
    out = []
    for low, high in held:
        for low2, high2 in held:
            if low2 >= low and low2 * least <= high + 1e-9:
                shared = max(1, math.ceil(least / (1 + least) * (low + low2) - 1e-9))
                few = [k for k in range(2, min(shared, MOST_CHOSEN) + 1) if math.comb(max(high, high2) - shared + k, k) <= CHOICES]
                out.append((low, low2, shared, max(few, default=1)))
    return out


def class_links(classes: DataFrame, least: float, names: tuple[str, ...] = ("class",)) -> DataFrame:
    """(a, b, score) of sets (class, set, n), grams in one order, of similarity ``least`` or more, a < b. With a second name, which tells
    sets of one class apart, sets of different classes meet."""
    sizes = [r.n for r in classes.select("n").distinct().collect()]  # a row per size
    bands, own = _bands(max(sizes, default=0)), list(names)
    low = F.coalesce(*[F.when(F.col("n").between(x, y), F.lit(x)) for x, y in bands]) if bands else F.lit(0)
    meets = _meetings(sizes, least)
    plans: dict[int, list] = {}
    for x, y, shared, chosen in meets:
        for mine in {x, y}:
            plans.setdefault(mine, []).append((x, y, shared, chosen))
    kind = "array<struct<x:int,y:int,shared:int,chosen:int>>"
    partner = F.lit(None).cast(kind)
    for mine, rows in plans.items():
        listed = F.array(*[F.struct(*[F.lit(v).cast("int").alias(c) for v, c in zip(r, ("x", "y", "shared", "chosen"), strict=True)]) for r in rows])
        partner = F.when(low == mine, listed).otherwise(partner)
    spread = classes.withColumn("m", F.explode(partner)).select(*own, "set", "n", low.alias("low"), "m.*")
    placed = spread.withColumn("first", F.slice("set", F.lit(1), F.greatest(F.lit(0), F.least(F.col("n"), F.col("n") - F.col("shared") + F.col("chosen")))))
    choice = F.transform(F.sequence(F.lit(0), F.size("first") - 1), lambda i: F.struct(i.alias("at"), F.xxhash64(F.get("first", i)).alias("key")))
    choices = F.when((F.col("chosen") == 1) & (F.size("first") > 0), choice)
    for k in sorted({c for *_, c in meets if c > 1}):
        for size in range(k, k + max(sizes) + 1):
            if math.comb(size, k) > CHOICES:
                break
            rows = [F.struct(F.lit(c[0]).alias("at"), F.xxhash64(*[F.get("first", F.lit(i)) for i in c]).alias("key")) for c in combinations(range(size), k)]
            choices = F.when((F.col("chosen") == k) & (F.size("first") == size), F.array(*rows)).otherwise(choices)
    keys = materialize(placed.select(*own, "n", "low", "x", "y", F.explode(choices).alias("c")).select(*own, "n", "low", "x", "y", "c.at", "c.key"))
    a, b = (keys.select("x", "y", "key", *[F.col(c).alias(f"{s}{k or ''}") for k, c in enumerate(own)], F.col("n").alias(f"n{s}"), F.col("low").alias(f"low{s}"), (F.col("n") - F.col("at")).alias(f"left{s}")) for s in "ab")
    fits = F.least("lefta", "leftb") >= F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    ends = [c for s in "ab" for c in ([s] if len(own) == 1 else [s, f"{s}1"])]
    met = a.join(b, ["x", "y", "key"]).where((F.col("a") < F.col("b")) & ((F.col("x") == F.col("y")) | (F.col("lowa") != F.col("lowb"))) & fits).select(*ends).distinct()
    one, two = (classes.select(*[F.col(c).alias(f"{s}{k or ''}") for k, c in enumerate(own)], F.col("set").alias(f"set{s}")) for s in "ab")
    shared = F.size(F.array_intersect("seta", "setb"))
    score = shared / (F.size("seta") + F.size("setb") - shared)
    return met.join(one, ends[: len(own)]).join(two, ends[len(own) :]).select("a", "b", score.alias("score")).where(F.col("score") >= least)


def jaccard_rows(rows: DataFrame, id_col: str, grams: Column, least: float) -> tuple[DataFrame, DataFrame]:
    """Like :func:`jaccard_classes` for one set a row, an array. Rows of an id that has several different sets are in no class: each
    is linked by itself, also with equal sets, so links and members give every pair of rows of two ids, and no other."""
    by = Window.partitionBy("id")
    plain = rows.select(F.col(id_col).alias("id"), F.array_sort(grams).alias("plain")).where("id is not null and plain is not null").distinct()
    placed = materialize(plain.withColumn("k", F.count("*").over(by)).withColumn("part", F.when(F.col("k") > 1, F.row_number().over(by.orderBy("plain"))).otherwise(0)))
    single = placed.where("k = 1")
    firsts = materialize(single.groupBy("plain").agg(F.min("id").alias("class")))
    each = firsts.select("class", F.lit(0).alias("part"), "plain").unionByName(placed.where("k > 1").select(F.col("id").alias("class"), "part", "plain"))
    long = each.select("class", "part", F.explode("plain").alias("gram"))
    ordered = long.join(long.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("class", "part").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("l"))
    classes = materialize(ordered.select("class", "part", F.transform("l", lambda x: x["gram"]).alias("set"), F.size("l").alias("n")))
    return class_links(classes, least, ("class", "part")), single.join(firsts, "plain").select("id", "class")


def jaccard_pairs(grams: DataFrame, id_col: str, least: float) -> DataFrame:
    """All pairs of sets of similarity ``least`` or more, copies multiplied out: for tables whose copies are known to be few. See
    :func:`jaccard_classes` for the others."""
    links, members = jaccard_classes(grams, id_col, least)
    members = materialize(members)
    if least <= 1:
        several = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
        links = links.unionByName(several.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("score")))
    similar = links.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "score")
    x, y = (members.select(F.col("class").alias(f"c{k}"), F.col("id").alias(k)) for k in "ab")
    pairs = similar.join(x, "ca").join(y, "cb").where((F.col("ca") != F.col("cb")) | (F.col("a") < F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 6).alias("jaccard"))


def repeated(rows: DataFrame, keys: list[str], size: str, id_col: str, least: int = 2, examples: int = 3) -> DataFrame:
    """Groups of at least ``least`` rows: count, largest and total size, and the smallest ids as examples. Groups are counted
    before examples are taken, and each task keeps only the ids that are among its smallest."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("imports"), F.max(size).alias("largest"), F.sum(size).alias("total")).where(F.col("imports") >= least)
    few = rows.join(groups.select(*keys), keys, "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(id_col))).where(F.col("_r") <= examples)
    named = few.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), ",").alias("examples"))
    return groups.join(named, keys)


def weighted_vote(votes: DataFrame, unit: str, revision: str) -> DataFrame:
    """Best revision of each unit by the sum of ``w`` times ``similarity``, with ``w`` again where ``unchanged``; scores within
    1e-9 are equal, and then the earlier ``date`` wins, then the revision."""
    score = F.sum(F.col("w") * F.col("similarity") + F.when(F.col("unchanged"), F.col("w")).otherwise(F.lit(0.0)))
    sums = votes.groupBy(unit, revision).agg(F.min("date").alias("date"), score.alias("score"))
    first = F.row_number().over(Window.partitionBy(unit).orderBy(F.desc(F.round("score", 9)), "date", revision))
    return sums.withColumn("_r", first).where("_r = 1").select(unit, revision, F.round("score", 4).alias("score"))


def cluster_summary(units: DataFrame, terms: DataFrame, cluster: str, id_col: str, time: str, k: int, samples: int) -> DataFrame:
    """Per cluster its k most frequent terms, number of units, period and smallest ids."""
    counted = terms.groupBy(cluster, "term").agg(F.count("*").alias("n"))
    best = counted.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), "term"))).where(F.col("_r") <= k)
    named = best.groupBy(cluster).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "term"))), lambda t: t["term"]), " ").alias("terms"))
    few = units.withColumn("_r", F.row_number().over(Window.partitionBy(cluster).orderBy(id_col))).where(F.col("_r") <= samples)
    sampled = few.groupBy(cluster).agg(F.array_join(F.sort_array(F.collect_list(id_col)).cast("array<string>"), ",").alias("samples"))
    whole = units.groupBy(cluster).agg(F.count("*").alias("units"), F.min(time).alias("first"), F.max(time).alias("last"))
    return whole.join(named, cluster).join(sampled, cluster)


def _subtrees(value, pointer: str, out: list) -> None:
    body = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    out.append((pointer, hashlib.sha256(body.encode()).hexdigest(), len(body.encode())))
    members = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for key, inner in members:
        if isinstance(inner, (dict, list)):
            _subtrees(inner, f"{pointer}/{str(key).replace('~', '~0').replace('/', '~1')}", out)


def subtrees(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Objects and arrays of each JSON text: (id, pointer, parent, digest of the canonical form, bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True):
                try:
                    value = json.loads(body)
                except (TypeError, ValueError):
                    continue
                found: list = []
                _subtrees(value, "", found)
                rows += [(key, p, p.rsplit("/", 1)[0] if p else None, h, n) for p, h, n in found]
            yield pd.DataFrame(rows, columns=["id", "pointer", "parent", "digest", "bytes"])

    return docs.select(F.col(id_col).alias("id"), text).mapInPandas(run, "id long, pointer string, parent string, digest string, bytes long")


def repeated_subtrees(docs: DataFrame, id_col: str, text: str, least_bytes: int = 64) -> DataFrame:
    """Subtrees of at least ``least_bytes`` that occur more than once, outermost only: an occurrence counts if its parent
    doesn't repeat. Digest, occurrences that count, documents, bytes of one, and bytes that one copy would save."""
    every = materialize(subtrees(docs, id_col, text))
    often = every.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    hit = every.join(often, "digest")
    outer = hit.join(hit.select("id", F.col("pointer").alias("parent")), ["id", "parent"], "left_anti")
    groups = outer.groupBy("digest").agg(F.count("*").alias("occurrences"), F.countDistinct("id").alias("documents"), F.max("bytes").alias("bytes"))
    return groups.where("occurrences > 1").withColumn("redundant", (F.col("occurrences") - 1) * F.col("bytes"))
