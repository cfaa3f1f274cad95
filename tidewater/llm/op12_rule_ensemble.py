"""Quality classifier as a sparse rule ensemble over text statistics.

Shallow trees are grown on the statistics of labelled texts; every path from a root is a rule, a conjunction of bounds. The
rules' weights are those of a logistic regression under a lasso penalty, which leaves most at zero. It never iterates over
texts: rows that meet the same rules are one weighted pattern, counted over all labelled rows. What stays is compiled into
one Spark column over the statistics, so scoring is a projection in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.op3_quality_rules import MEASURES, ledger
from tidewater.workspace import compacted, materialize, written

#: Statistic -> SQL over the measurements of the ledger; none reads a label, a language, a source or an id.
STATISTICS = {
    "words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "stutter": "n_stutters / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "same_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "plain_letters": "n_letters / greatest(word_chars, 1)",
}
THRESHOLD = 0.7
TRAIN_ROWS = 200_000  # labelled rows that the trees see, about; weights are fitted on all
TREES, DEPTH, LEAF = 24, 3, 5
LASSO = 0.0005
PARTS = 8

Bounds = tuple[tuple[str, float, float], ...]  # (statistic, more than, at most), by statistic


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 by division by 4. A row without an id has no label."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of each whole text; null and empty texts have 0 everywhere. Each text is read once."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    measured = ledger(slim).select("doc_id", *[F.col("ledger")[m].alias(m) for m in MEASURES])
    return measured.select("doc_id", *[F.expr(sql).cast("double").alias(name) for name, sql in STATISTICS.items()])


def condition(rule: Bounds) -> Column:
    """The rule as a column over the statistics."""
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (F.col(name) > low)
        if high < math.inf:
            out = out & (F.col(name) <= high)
    return out


@dataclass
class Ensemble:
    """Weighted rules; ``base`` is the log odds of a text that meets none."""

    base: float
    weights: dict[Bounds, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Probability of label 1, over the statistics."""
        odds = F.lit(self.base)
        for rule, weight in self.weights.items():
            odds = odds + F.when(condition(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def describe(self) -> list[tuple[str, float]]:
        """The rules in words, heaviest first."""
        side = lambda n, a, b: " and ".join([f"{n} > {a:g}"] * (a > -math.inf) + [f"{n} <= {b:g}"] * (b < math.inf))
        return sorted(((" and ".join(side(*x) for x in rule), w) for rule, w in self.weights.items()), key=lambda x: -abs(x[1]))


def path_rules(forest, names: list[str]) -> list[Bounds]:
    """Every path from a root to a node below it, once; of two rules that complement one another only the first."""
    out: dict[Bounds, None] = {}

    def walk(node, held: dict[str, tuple[float, float]]) -> None:
        if held:
            rule = tuple((n, *held[n]) for n in sorted(held))
            name, low, high = rule[0]
            opposite = ((name, high, math.inf) if low == -math.inf else (name, -math.inf, low),) if len(rule) == 1 and math.inf in (-low, high) else None
            if opposite not in out:
                out[rule] = None
        if node.subtreeDepth() == 0:
            return
        name, at = names[node.split().featureIndex()], node.split().threshold()
        low, high = held.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), held | {name: (low, min(high, at))})
        walk(node.rightChild(), held | {name: (max(low, at), high)})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(out)


def _labelled(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """Statistics with their labels, without the rows held out; labels other than 0 and 1 are none."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("label")).where("label in (0, 1)")
    return stats.where(~held_out(F.col("doc_id"))).join(known.where(~held_out(F.col("doc_id"))), "doc_id")


def grow(train: DataFrame, seed: int = 12) -> list[Bounds]:
    """The path rules of a small forest over (doc_id, statistics, label). Rows are dealt and sorted by value, so the forest
    doesn't depend on their order."""
    names = list(STATISTICS)
    dealt = train.repartition(PARTS, "doc_id").sortWithinPartitions("doc_id", "label", *names)
    rows = materialize(dealt.select(array_to_vector(F.array(*names)).alias("features"), "label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAF, maxBins=64, featureSubsetStrategy="onethird", seed=seed)
    return path_rules(forest.fit(rows), names)


def patterns(train: DataFrame, rules: list[Bounds]) -> DataFrame:
    """(met, label, n): the rules that rows meet, one digit each, with their number; combined before the shuffle."""
    met = F.concat(*[F.when(condition(r), F.lit("1")).otherwise(F.lit("0")) for r in rules])
    return train.select(met.alias("met"), "label").groupBy("met", "label").agg(F.count("*").cast("double").alias("n"))


def weigh(counted: DataFrame, rules: list[Bounds], lasso: float = LASSO) -> Ensemble:
    """Lasso logistic weights of the rules from their counted patterns."""
    digits = F.transform(F.split("met", ""), lambda x: x.cast("double"))
    rows = compacted(counted.select("met", array_to_vector(F.slice(digits, 1, len(rules))).alias("features"), "label", "n"))[0]
    model = LogisticRegression(weightCol="n", elasticNetParam=1.0, regParam=lasso, maxIter=200, tol=1e-9).fit(rows)
    return Ensemble(model.intercept, {r: w for r, w in zip(rules, model.coefficients.toArray().tolist(), strict=True) if w})


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", train_rows: int = TRAIN_ROWS, lasso: float = LASSO) -> Ensemble:
    """The ensemble for rows of :func:`statistics`.

    The trees see a sample of about ``train_rows`` labelled rows, drawn by a hash of the id; thresholds and counts of the
    weights come from all of them. Without rows of both labels the score is the labels' smoothed share everywhere: 0.5
    without any. A document of several labels, or of several rows, counts once for each pair.
    """
    train = written(_labelled(stats, labels, id_col, label_col), "labelled")
    share = {r.label: r.n for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, all_rows = share.get(1.0, 0), sum(share.values())
    if len(share) < 2:
        return Ensemble(math.log((good + 1) / (all_rows - good + 1)))
    part = min(1.0, train_rows / all_rows)
    rules = grow(train.where((F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 < F.lit(part * 1_000_003)))
    if not rules:  # no statistic parts the sample
        return Ensemble(math.log((good + 1) / (all_rows - good + 1)))
    return weigh(patterns(train, rules), rules, lasso)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DataFrame:
    """One row per document: doc_id, held_out, the score of label 1 and whether it reaches 0.7.

    Null and empty texts are scored by their statistics, which are 0. Repeated rows are scored alike; an empty table gives
    no rows. Columns of ``docs`` and ``labels`` other than the named ones take no part.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    model = fit(stats, labels, id_col, label_col, **options)
    score = model.score()
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
