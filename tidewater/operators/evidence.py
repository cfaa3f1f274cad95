"""The evidence pipeline: observations, artifact types, typed items, remaps, rules, principles, operators, judgements, audits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.functions.text import let
from tidewater.operators.graph import components
from tidewater.workspace import materialize


def observations(texts: DataFrame, id_col: str, text: str) -> DataFrame:
    """Typed blocks of texts: (id, block, kind, first, lines, chars). Fenced lines are code; headings, bullets, table rows and
    quotes are told by their first signs; blank lines part blocks; consecutive lines of a kind (but single headings and
    bullets) are one block."""
    lines = texts.select(id_col, F.posexplode(F.split(text, "\n")).alias("p", "line"))
    by_text = Window.partitionBy(id_col).orderBy("p")
    fence = F.col("line").rlike(r"^\s*(```|~~~)")
    inside = F.sum(F.when(fence, 1).otherwise(0)).over(by_text.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    kind = (
        F.when(fence | inside, "code").when(F.trim("line") == "", "blank").when(F.col("line").rlike(r"^#+ "), "heading")
        .when(F.col("line").rlike(r"^\s*([-*+]|[0-9]{1,3}[.)]) "), "bullet").when(F.col("line").rlike(r"^\s*\|"), "table").when(F.col("line").rlike(r"^>"), "quote").otherwise("prose")
    )
    known = lines.withColumn("kind", kind)
    starts = F.when((F.col("kind") != F.lag("kind", 1, "").over(by_text)) | F.col("kind").isin("heading", "bullet"), 1).otherwise(0)
    runs = known.withColumn("_b", starts).withColumn("_b", F.sum("_b").over(by_text.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> 'blank'")
    blocks = runs.groupBy(id_col, "_b", "kind").agg(F.min("p").alias("first"), F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))
    return blocks.withColumn("block", F.row_number().over(Window.partitionBy(id_col).orderBy("_b"))).drop("_b")


@dataclass(frozen=True)
class Cue:
    """A weighted sign of an artifact type: an operation of the closed set, its argument and its weight."""

    artifact: str
    op: str
    value: str
    weight: float


def _cue(op: str, value: str) -> Column:
    text, path = F.col("text"), F.col("path")
    glob = "^" + value.replace(".", r"\.").replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*").replace("?", "[^/]") + "$"
    ops = {
        "file_ext": lambda: F.lower(path).endswith("." + value), "path_glob": lambda: path.rlike(glob), "mime": lambda: F.col("mime") == value,
        "json_key": lambda: F.coalesce(F.array_contains(F.json_object_keys(text), value), F.lit(False)), "heading": lambda: text.rlike(rf"(?im)^#+ .*{value}"),
        "cue": lambda: S.has_phrase(text, value),
    }
    if op not in ops:
        raise ValueError(f"no operation {op}; there are {sorted(ops)}")
    return F.coalesce(ops[op](), F.lit(False))


def artifacts(units: DataFrame, id_col: str, cues: list[Cue], least: float) -> DataFrame:
    """Artifact types of units (path, mime, text) by the weights of their cues: those of ``least`` or more with a rank,
    score descending, then type."""
    names = sorted({c.artifact for c in cues})
    scores = [F.struct(F.lit(n).alias("artifact"), F.round(reduce(Column.__add__, (F.when(_cue(c.op, c.value), c.weight).otherwise(0.0) for c in cues if c.artifact == n)), 6).alias("score")) for n in names]
    found = units.select(id_col, F.explode(F.array(*scores)).alias("s")).select(id_col, "s.*").where(F.col("score") >= least)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "artifact")))


def classify(sentences: DataFrame, id_col: str, text: str, cues: list[tuple[str, str, float]], priority: list[str], question: str = "question", least: float = 1.0) -> DataFrame:
    """Type of each sentence by weighted cue phrases (phrase, type, weight): the largest sum, ties by ``priority``; a final
    question mark weighs 2 for ``question``. Below ``least`` the type is null. Confidence rises with the sum and falls where
    the second type is close."""
    types = list(dict.fromkeys([*priority, *(t for _, t, _ in cues)]))

    def total(t: str) -> Column:
        parts = [F.when(S.has_phrase(F.col(text), p), w).otherwise(0.0) for p, kind, w in cues if kind == t]
        if t == question:
            parts.append(F.when(F.rtrim(F.col(text)).rlike(r"\?[\"'”’)\]]*$"), 2.0).otherwise(0.0))
        return reduce(Column.__add__, parts, F.lit(0.0))

    scored = sentences.select(id_col, F.sort_array(F.array(*[F.struct((-total(t)).alias("low"), F.lit(k).alias("k"), F.lit(t).alias("type")) for k, t in enumerate(types)])).alias("_s"))
    best, second = -F.get("_s", 0)["low"], -F.get("_s", 1)["low"]
    confidence = F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.4 + 0.15 * best - F.when(best - second < 0.5, 0.2).otherwise(0.0))), 4)
    return scored.select(id_col, F.when(best >= least, F.get("_s", 0)["type"]).alias("type"), F.when(best >= least, confidence).alias("confidence"))


def remapped(claims: DataFrame, remap: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims about canonical entities, those that become equal as one of smallest id and largest confidence, and the ids that
    others supersede. ``remap`` is (entity, canonical)."""
    to = lambda side: remap.select(F.col("entity").alias(side), F.col("canonical").alias(f"_{side}"))
    known = claims.join(to("subject"), "subject", "left").join(to("object"), "object", "left")
    known = known.withColumns({"subject": F.coalesce("_subject", "subject"), "object": F.coalesce("_object", "object")}).drop("_subject", "_object")
    merged = known.groupBy("subject", *keep, "object").agg(F.min("id").alias("id"), F.max("confidence").alias("confidence"), F.count("*").alias("merged"))
    gone = known.join(merged.withColumnRenamed("id", "by").select("subject", *keep, "object", "by"), ["subject", *keep, "object"]).where("id <> by").select("id", "by")
    return merged, gone


@dataclass(frozen=True)
class Rule:
    """``head(x, z)`` from a chain of body relations ``b1(x, y), b2(y, z)``, or from one; a leading ``~`` walks it backwards."""

    head: str
    body: tuple[str, ...]
    stratum: int = 0


def infer(facts: DataFrame, rules: list[Rule], most: int = 50) -> DataFrame:
    """All facts (s, p, o, depth) that follow, stratum by stratum, each to its fixpoint; given facts have depth 0. Each round joins
    what is new with all that is known, so no conclusion is drawn twice. Raises if a stratum isn't done after ``most`` rounds."""
    known = [materialize(facts.select("s", "p", "o").distinct().withColumn("depth", F.lit(0)))]

    def side(rows: DataFrame, relation: str, a: str, b: str) -> DataFrame:
        back = relation.startswith("~")
        return rows.where(F.col("p") == relation.lstrip("~")).select(F.col("o" if back else "s").alias(a), F.col("s" if back else "o").alias(b))

    for stratum in sorted({r.stratum for r in rules}):
        own, new = [r for r in rules if r.stratum == stratum], reduce(DataFrame.unionByName, known)
        for k in range(1, most + 2):
            every, parts = reduce(DataFrame.unionByName, known), []
            for r in own:
                if len(r.body) == 1:
                    parts.append(side(new, r.body[0], "s", "o").withColumn("p", F.lit(r.head)))
                else:
                    for one, two in ((new, every), (every, new)):
                        parts.append(side(one, r.body[0], "s", "_m").join(side(two, r.body[1], "_m", "o"), "_m").select("s", "o").withColumn("p", F.lit(r.head)))
            found = reduce(DataFrame.unionByName, parts).select("s", "p", "o").distinct().join(every, ["s", "p", "o"], "left_anti")
            new = materialize(found.withColumn("depth", F.lit(k)))
            if new.isEmpty():
                break
            known.append(new)
            if len(known) > 6:  # few tables in a plan, however many rounds there are
                known = [materialize(reduce(DataFrame.unionByName, known))]
        else:
            raise RuntimeError(f"stratum {stratum} isn't done after {most} rounds")
    return reduce(DataFrame.unionByName, known)


def missing_properties(facts: DataFrame, classes: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """(node, class, property) of expected properties that a class's members lack."""
    want = F.explode(F.element_at(F.create_map(*[x for c, ps in expected.items() for x in (F.lit(c), F.array(*[F.lit(p) for p in ps]))]), F.col("class")))
    asked = classes.where(F.col("class").isin(list(expected))).select("node", "class", want.alias("property"))
    return asked.join(facts.select(F.col("s").alias("node"), F.col("p").alias("property")).distinct(), ["node", "property"], "left_anti").select("node", "class", "property")


def memberships(parts: DataFrame, areas: DataFrame, least: float) -> DataFrame:
    """(unit, area, share): areas that hold at least a share of a unit's entities; ``parts`` is (unit, entity), ``areas``
    (entity, area)."""
    sizes = parts.groupBy("unit").agg(F.countDistinct("entity").alias("_n"))
    both = parts.distinct().join(areas.distinct(), "entity").groupBy("unit", "area").agg(F.count("*").alias("_k"))
    return both.join(sizes, "unit").select("unit", "area", F.round(F.col("_k") / F.col("_n"), 6).alias("share")).where(F.col("share") >= least)


def similar_sets(terms: DataFrame, least: float, how: str = "jaccard") -> DataFrame:
    """Pairs (i, j, score) of term sets (id, term) that score ``least`` or more: ``jaccard`` and ``overlap`` weighted by
    ln(1 + N/df), or ``mean`` of the plain two. Only pairs that share a term are made."""
    sets = materialize(terms.distinct())
    n = sets.select("id").distinct().count()
    weight = F.lit(1.0) if how == "mean" else F.log1p(F.lit(float(n)) / F.col("df"))
    weighted = materialize(sets.join(sets.groupBy("term").agg(F.count("*").alias("df")), "term").select("id", "term", weight.alias("w")))
    sizes = weighted.groupBy("id").agg(F.sum("w").alias("size"))
    shared = weighted.select(F.col("id").alias("i"), "term", "w").join(weighted.select(F.col("id").alias("j"), "term"), "term").where("i < j").groupBy("i", "j").agg(F.sum("w").alias("both"))
    known = shared.join(sizes.select(F.col("id").alias("i"), F.col("size").alias("a")), "i").join(sizes.select(F.col("id").alias("j"), F.col("size").alias("b")), "j")
    jaccard, overlap = F.col("both") / (F.col("a") + F.col("b") - F.col("both")), F.col("both") / F.least("a", "b")
    score = {"jaccard": jaccard, "overlap": overlap, "mean": 0.5 * overlap + 0.5 * jaccard}[how]
    return known.select("i", "j", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def principles(statements: DataFrame, terms: DataFrame, least: float, least_units: int, least_dates: int) -> DataFrame:
    """Clusters of statements (id, unit, date, confidence) by single links of weighted Jaccard: with enough units and dates a
    principle (smallest id), its support, and confidence 1 - (1 - best) * 0.7 ^ units."""
    links = similar_sets(terms, least).select(F.col("i").alias("source"), F.col("j").alias("target"))
    groups = components(links, statements.select(F.col("id").alias("node")))
    held = statements.join(groups.select(F.col("node").alias("id"), F.col("component").alias("principle")), "id").groupBy("principle")
    out = held.agg(F.count("*").alias("statements"), F.countDistinct("unit").alias("units"), F.countDistinct("date").alias("dates"), F.max("confidence").alias("_c"))
    sure = F.round(1 - (1 - F.col("_c")) * F.pow(F.lit(0.7), F.col("units")), 4)
    return out.where((F.col("units") >= least_units) & (F.col("dates") >= least_dates)).withColumn("confidence", sure).drop("_c")


def typed(principle: DataFrame, thresholds: list[tuple[str, Column]], other: str) -> DataFrame:
    """Each principle's first type whose condition holds."""
    kind = reduce(lambda out, t: F.when(t[1], t[0]).otherwise(out), reversed(thresholds), F.lit(other))
    return principle.withColumn("type", kind)


def attribute(units: DataFrame, seeds: DataFrame, least: float, margin: float, most: int = 100) -> DataFrame:
    """(id, project, score, round): units (id, term, w) that join a project: in each round profiles are the sums of the members'
    terms, and units whose best cosine is at least ``least`` and ``margin`` above the second join; until none does. Raises if some still do after ``most`` rounds."""
    norm = units.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
    unit = materialize(units.join(norm, "id").select("id", "term", (F.col("w") / F.col("_n")).alias("w")))
    members = [materialize(seeds.select("id", "project", F.lit(1.0).alias("score"), F.lit(0).alias("round")))]
    for k in range(1, most + 1):
        known = reduce(DataFrame.unionByName, members)
        profile = unit.join(known, "id").groupBy("project", "term").agg(F.sum("w").alias("p"))
        length = profile.groupBy("project").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("_l"))
        dots = unit.join(known.select("id"), "id", "left_anti").join(profile, "term").groupBy("id", "project").agg(F.sum(F.col("w") * F.col("p")).alias("_d"))
        scored = dots.join(F.broadcast(length), "project").select("id", "project", F.round(F.col("_d") / F.col("_l"), 6).alias("score"))  # a row a project
        order = Window.partitionBy("id").orderBy(F.desc("score"), "project")
        ranked = scored.withColumn("_r", F.row_number().over(order)).withColumn("_second", F.coalesce(F.lead("score").over(order), F.lit(0.0)))
        new = materialize(ranked.where((F.col("_r") == 1) & (F.col("score") >= least) & (F.col("score") - F.col("_second") >= margin)).select("id", "project", "score", F.lit(k).alias("round")))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, members)
        members.append(new)
        if len(members) > 6:  # few tables in a plan, however many rounds there are
            members = [materialize(reduce(DataFrame.unionByName, members))]
    raise RuntimeError(f"units still join after {most} rounds")


def reliability(runs: DataFrame, operator: str, held: str, at: str, until: Column) -> DataFrame:
    """Operators by their outcomes before the cut: successes, failures, and (s + 1) / (s + f + 2)."""
    seen = runs.where((F.col(at) < until) & F.col(held).isNotNull()).groupBy(operator).agg(F.count_if(held).alias("successes"), F.count_if(~F.col(held)).alias("failures"))
    return seen.withColumn("reliability", F.round((F.col("successes") + 1) / (F.col("successes") + F.col("failures") + 2), 6))


def prefix_terms(text: Column, n: int = 6) -> Column:
    """Distinct words cut to their first ``n`` letters."""
    return F.array_distinct(F.transform(S.word_tokens(text), lambda t: F.substring(t, 1, n)))


def replay(state: DataFrame, judgements: DataFrame, target: str, seq: str) -> DataFrame:
    """State by target after the judgements past the largest sequence number that it has seen: the last one wins."""
    seen = state.agg(F.coalesce(F.max(seq), F.lit(-1).cast("long")).alias("_seen"))
    new = judgements.join(F.broadcast(seen)).where(F.col(seq) > F.col("_seen")).select(*state.columns)
    rest = [c for c in state.columns if c not in (target, seq)]
    return state.unionByName(new).groupBy(target).agg(F.max(F.struct(seq, *rest)).alias("_j")).select(target, *[F.col(f"_j.{c}").alias(c) for c in (seq, *rest)])


def packet_report(nodes: DataFrame, links: DataFrame, stated: DataFrame, content: str) -> DataFrame:
    """What keeps a packet from being accepted: links to nodes it lacks, nodes it states but lacks, and contents whose hash
    isn't the stated one: (problem, node)."""
    ends = links.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    row = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("node").cast("long").alias("node"))
    drift = nodes.join(stated, "node").where(F.sha2(F.col(content).cast("binary"), 256) != F.col("digest"))
    return row(ends.join(nodes, "node", "left_anti"), "dangling").unionByName(row(stated.join(nodes, "node", "left_anti"), "missing")).unionByName(row(drift, "drift"))


def usage_bands(history: DataFrame, kind: str, tokens: str, price: str) -> DataFrame:
    """Cost estimates by kind from what was used before: low, typical and high (10th, 50th, 90th percentile of tokens times the
    price); null without a price."""
    q = lambda p: F.percentile(tokens, F.lit(p))
    bands = history.groupBy(kind, price).agg(F.count("*").alias("uses"), q(0.1).alias("_l"), q(0.5).alias("_t"), q(0.9).alias("_h"))
    return bands.select(kind, "uses", *[F.round(F.col(c) * F.col(price), 6).alias(n) for c, n in (("_l", "low"), ("_t", "typical"), ("_h", "high"))])


def import_audit(expected: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Counts that a source states against what was imported, by key: complete, partial, missing, surplus or unexpected."""
    both = expected.select(key, F.col("n").alias("expected")).join(imported.groupBy(key).agg(F.count("*").alias("imported")), key, "full")
    e, i = F.col("expected"), F.coalesce("imported", F.lit(0).cast("long"))
    verdict = F.when(e.isNull(), "unexpected").when(i == 0, "missing").when(i < e, "partial").when(i > e, "surplus").otherwise("complete")
    return both.select(key, "expected", i.alias("imported"), verdict.alias("verdict"))


def item_links(items: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """Edges between items (id, type, polarity, date) whose subjects (id, term) overlap with a weight of ``least`` or more:
    the later one ``contradicts`` an earlier of other polarity, ``supersedes`` an earlier of the same type and polarity."""
    pairs = similar_sets(terms, least, "overlap")
    known = pairs.join(items.select(F.col("id").alias("i"), *[F.col(c).alias(f"_a_{c}") for c in ("type", "polarity", "date")]), "i").join(items.select(F.col("id").alias("j"), *[F.col(c).alias(f"_b_{c}") for c in ("type", "polarity", "date")]), "j")
    newer_is_j = (F.col("_b_date") > F.col("_a_date")) | ((F.col("_b_date") == F.col("_a_date")) & (F.col("j") > F.col("i")))
    kind = F.when(F.col("_a_polarity") != F.col("_b_polarity"), "contradicts").when(F.col("_a_type") == F.col("_b_type"), "supersedes")
    out = known.select(F.when(newer_is_j, F.col("j")).otherwise(F.col("i")).alias("source"), F.when(newer_is_j, F.col("i")).otherwise(F.col("j")).alias("target"), kind.alias("type"), "score")
    return out.where(F.col("type").isNotNull())


def json_records(docs: DataFrame, id_col: str, text: str, selector: str, fields: dict[str, str]) -> DataFrame:
    """Records of a JSON array that ``selector`` points to: (id, n, each field's value, ``unavailable`` fields, ``unknown_fields``).
    Field paths begin at the record; a record's members that no field reads are kept by name."""
    items = F.from_json(F.get_json_object(text, selector), "array<string>")
    rows = docs.select(id_col, F.posexplode(items).alias("n", "record"))
    values = {f: F.get_json_object("record", path) for f, path in fields.items()}
    read = {path.split(".")[1].split("[")[0] for path in fields.values() if path.startswith("$.")}
    lacks = F.array_compact(F.array(*[F.when(v.isNull(), F.lit(f)) for f, v in values.items()]))
    unknown = let(F.json_object_keys("record"), lambda k: F.sort_array(F.array_except(k, F.array(*[F.lit(x) for x in sorted(read)]))))
    return rows.select(id_col, "n", *[v.alias(f) for f, v in values.items()], lacks.alias("unavailable"), F.coalesce(unknown, F.array().cast("array<string>")).alias("unknown_fields"))
