"""Line dedup by winnowing over line hashes, in DataFrame functions only.

The unit is the line that holds a word. A window is the shortest run of consecutive lines of one document that reaches
``min_words`` words; a line that has them alone is a window by itself. Of each window the smallest line hash is selected;
the positions so selected are the document's fingerprints, fewer than its lines, and two documents that share a run of at
least ``min_words`` words are guaranteed to share one. Positions are joined on the fingerprint alone; one that occurs only
once ends there. The others take the lines around them, and each is matched with the first position of its fingerprint:
the match is extended to the left and to the right, line hash by line hash, as far as both agree, and every window inside
it is a later repeat. Windows that reach beyond the match have no copy at the first position, but may have one at another
position of that fingerprint; these few are compared with each other by all their line hashes. So no pairs of occurrences
are made, and none is lost. Windows grown to the right from each line and to the left from each line cover exactly the
lines of every shared run. Of a run the first occurrence, by document id and line, stays; later ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.text import let
from tidewater.workspace import written

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"
_FIRST_ID = -(2**63)


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Rows equal in id and text are one document."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST_ID)).alias("d"), F.xxhash64(text_col).alias("t")]


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with a word: position p, number o among them, two 64-bit hashes, and word offsets s (first) and e (past the last)."""
    at = docs.select(*_row_key(id_col, text_col), F.posexplode(F.split(text_col, "\n")).alias("p", "line"))
    hashed = at.select("d", "t", "p", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).where("n > 0")
    own = hashed.repartition("d", "t").dropDuplicates(["d", "t", "p"])  # repeated rows; the partitioning serves the windows too
    so_far = Window.partitionBy("d", "t").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumns({"e": F.sum("n").over(so_far), "o": F.count("*").over(so_far)}).withColumn("s", F.col("e") - F.col("n"))


def positions(line: DataFrame, min_words: int) -> DataFrame:
    """Selected positions: fingerprint (h, g) of the line, its document (d, t) and number o, and the first and last line,
    each as (o, p), of the windows it is the least of."""
    right = Window.partitionBy("d", "t").orderBy("s").rangeBetween(0, min_words - 1)
    left = Window.partitionBy("d", "t").orderBy("e").rangeBetween(-(min_words - 1), 0)

    def reach(frame) -> Column:
        return F.struct(
            F.min(F.struct("h", "g", "o")).over(frame).alias("least"),
            F.min(F.struct("o", "p")).over(frame).alias("first"),
            F.max(F.struct("o", "p")).over(frame).alias("last"),
            F.min("s").over(frame).alias("s"),
            F.max("e").over(frame).alias("e"),
        )

    both = line.select("d", "t", "n", reach(right).alias("r"), reach(left).alias("l"))
    # a window that grew to the left is new unless it stays long enough without its last line's start
    found = both.select(
        "d", "t",
        F.explode(F.array(
            F.struct(F.lit(True).alias("new"), F.col("r")),
            F.struct((F.col("l.e") - F.col("l.s") - F.col("n") >= min_words).alias("new"), F.col("l").alias("r")),
        )).alias("w"),
    ).where(F.col("w.new") & (F.col("w.r.e") - F.col("w.r.s") >= min_words))
    windows = F.collect_list(F.struct(F.col("w.r.first").alias("first"), F.col("w.r.last").alias("last"))).alias("windows")
    return found.groupBy("d", "t", F.col("w.r.least.o").alias("o")).agg(F.first("w.r.least.h").alias("h"), F.first("w.r.least.g").alias("g"), windows)


def joined_positions(position: DataFrame) -> DataFrame:
    """The positions whose fingerprint occurs at another position too. Counts are combined before they are shuffled, and
    adaptive execution may split the positions of a frequent fingerprint, as nothing is grouped by it."""
    repeated = position.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return position.join(repeated, ["h", "g"])


def with_context(position: DataFrame, line: DataFrame) -> DataFrame:
    """Positions with the hashes of the lines before them (``before``, nearest first) and from them on (``after``), as far
    as their windows reach. A document's lines meet its positions once, in one row each."""
    own = position.groupBy("d", "t").agg(F.collect_list(F.struct("h", "g", "o", "windows")).alias("at"))
    whole = line.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("o", "h", "g", "n"))).alias("own"))
    reach = lambda x: F.struct(
        x["h"].alias("h"), x["g"].alias("g"), x["o"].alias("o"), x["windows"].alias("windows"),
        F.array_min(x["windows"]["first"]["o"]).alias("from"), F.array_max(x["windows"]["last"]["o"]).alias("to"),
    )
    each = own.join(whole, ["d", "t"]).select("d", "t", F.inline(let(F.col("own"), lambda lines: F.transform(F.transform("at", reach), lambda x: F.struct(
        x["h"].alias("h"), x["g"].alias("g"), x["o"].alias("o"), x["windows"].alias("windows"),
        F.transform(F.reverse(F.slice(lines, x["from"].cast("int"), (x["o"] - x["from"]).cast("int"))), lambda y: F.struct(y["h"], y["g"])).alias("before"),
        F.transform(F.slice(lines, x["o"].cast("int"), (x["to"] - x["o"] + 1).cast("int")), lambda y: F.struct(y["h"], y["g"])).alias("after"),
    )))))
    return each


def _agreeing(one: Column, two: Column) -> Column:
    """How many lines from the start on agree."""
    differs = F.array_position(F.zip_with(one, two, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs == 0, F.size(one)).otherwise(differs - 1)


def extended(position: DataFrame) -> DataFrame:
    """Each position's windows, with whether the match with the first position of its fingerprint, extended both ways,
    holds the window (``inside``). First positions themselves have no row."""
    origin = position.groupBy("h", "g").agg(F.min(F.struct("d", "t", "o", "before", "after")).alias("origin"))
    met = position.join(origin, ["h", "g"]).where(F.struct("d", "t", "o") != F.struct("origin.d", "origin.t", "origin.o"))
    reach = met.withColumns({"left": _agreeing(F.col("before"), F.col("origin.before")), "right": _agreeing(F.col("after"), F.col("origin.after"))})
    each = reach.select("h", "g", "d", "t", "o", "left", "right", "before", "after", F.explode("windows").alias("w"))
    inside = (F.col("o") - F.col("w.first.o") <= F.col("left")) & (F.col("w.last.o") - F.col("o") < F.col("right"))
    rest = F.when(~inside, F.struct(F.slice("before", F.lit(1), (F.col("o") - F.col("w.first.o")).cast("int")).alias("before"), F.slice("after", F.lit(1), (F.col("w.last.o") - F.col("o") + 1).cast("int")).alias("after")))
    return each.select("h", "g", "d", "t", "w.first", "w.last", inside.alias("inside"), rest.alias("content"))


def beyond(window: DataFrame) -> DataFrame:
    """Later copies among the windows that no first position holds, by all their line hashes."""
    rest = window.where("not inside").select("d", "t", "first", "last", F.xxhash64("content").alias("a"), F.xxhash64(F.lit(7), "content").alias("b"))
    here = F.struct("d", "t", "first", "last")
    origin = rest.groupBy("a", "b").agg(F.min(here).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rest.join(origin, ["a", "b"]).where(here != F.col("origin")).select("d", "t", "first", "last")  # (o, p) orders as o does


def repeated_runs(line: DataFrame, min_words: int) -> DataFrame:
    """Per document the disjoint runs of lines to delete, in order."""
    window = written(extended(with_context(joined_positions(positions(line, min_words)), line)), "extended-windows")
    later = window.where("inside").select("d", "t", "first", "last").unionByName(beyond(window))
    order = Window.partitionBy("d", "t").orderBy("first", "last")
    reached = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("first.o") <= F.col("reached.o") + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = later.withColumn("reached", reached).withColumn("island", island).groupBy("d", "t", "island").agg(F.min("first")["p"].alias("first"), F.max("last")["p"].alias("last"))
    return runs.groupBy("d", "t").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with later repeated runs deleted from ``text_col``, and new columns ``lines_total``, ``lines_deleted``.

    Null and empty texts come back as they are (with 0 lines deleted). Rows equal in id and text count as one document and
    each comes back; a null id counts as the smallest. Lines without a word break no run; they go if the nearest lines with words before and after them go.
    Very frequent lines are combined before they are shuffled; the join that takes a run to its first occurrence is one
    that adaptive execution splits. Columns called like the new ones, or d, t and runs, must be renamed first.
    """
    runs = repeated_runs(lines(docs, id_col, text_col), min_words)
    clash = {"lines_total", "lines_deleted", "d", "t", "runs"} & set(docs.columns)
    if clash:
        raise ValueError(f"the input has columns named {sorted(clash)}")
    split = F.split(text_col, "\n")
    end = F.element_at("runs", -1)["last"]
    gaps = F.transform("runs", lambda r, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("runs"), i - 1)["last"] + 1).alias("at"), r["first"].alias("to")))
    kept = let(split, lambda own: F.flatten(F.concat(F.transform(gaps, lambda g: F.slice(own, g["at"] + 1, g["to"] - g["at"])), F.array(F.slice(own, end + 2, F.size(own))))))
    gone = F.aggregate("runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    joined = docs.select("*", *_row_key(id_col, text_col)).join(runs, ["d", "t"], "left")
    return joined.withColumns(
        {
            text_col: F.when(F.col("runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
            "lines_total": F.coalesce(F.size(split), F.lit(0)),
            "lines_deleted": F.coalesce(F.when(F.col("runs").isNotNull(), gone), F.lit(0)),
        }
    ).select(*docs.columns, "lines_total", "lines_deleted")


def oracle_sql(min_words: int = MIN_WORDS) -> str:
    """DuckDB twin of :func:`dedup_lines` over ``documents(doc_id, text)`` with unique ids."""
    frame = "(PARTITION BY doc_id ORDER BY {0} RANGE BETWEEN {1})"
    right, left = frame.format("s", f"CURRENT ROW AND {min_words - 1} FOLLOWING"), frame.format("e", f"{min_words - 1} PRECEDING AND CURRENT ROW")
    reach = lambda w: f"list(line) OVER {w} AS content, min(o) OVER {w} AS a, max(o) OVER {w} AS b, max(e) OVER {w} - min(s) OVER {w} AS words"
    return rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
 n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
 k AS (SELECT doc_id, line, p, n, sum(n) OVER q AS e, sum(n) OVER q - n AS s, row_number() OVER q AS o FROM n WHERE n > 0 WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
 w AS (SELECT DISTINCT doc_id, content, a, b FROM (SELECT doc_id, {reach(right)} FROM k UNION ALL SELECT doc_id, {reach(left)} FROM k) WHERE words >= {min_words}),
 x AS (SELECT doc_id, a, b FROM w QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, a) > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS o FROM x),
 marked AS (SELECT n.doc_id, n.p, n.line, n.n, coalesce(sum(CASE WHEN n.n > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY n.doc_id ORDER BY n.p), 0) AS o FROM n),
 f AS (SELECT m.*, g.o IS NOT NULL AND (m.n > 0 OR h.o IS NOT NULL) AS del FROM marked m LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.o = m.o LEFT JOIN gone h ON h.doc_id = m.doc_id AND h.o = m.o + 1),
 r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT del), '') AS text, count(*)::INTEGER AS lines_total, (count(*) FILTER (del))::INTEGER AS lines_deleted FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN lines_deleted > 0 THEN r.text ELSE d.text END AS text, coalesce(lines_total, 0)::INTEGER AS lines_total, coalesce(lines_deleted, 0)::INTEGER AS lines_deleted FROM documents d LEFT JOIN r USING (doc_id)
"""
