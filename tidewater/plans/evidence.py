"""Queries of the evidence pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import evidence as E
from tidewater.plans.registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "text_observations",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
 f AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM l), i AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY p) % 2 = 1 AS inside FROM f),
 k AS (SELECT *, CASE WHEN fence OR inside THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#+ ') THEN 'heading' WHEN regexp_matches(line, '^\s*([-*+]|[0-9]{1,3}[.)]) ') THEN 'bullet' WHEN regexp_matches(line, '^\s*\|') THEN 'table' WHEN regexp_matches(line, '^>') THEN 'quote' ELSE 'prose' END AS kind FROM i),
 s AS (SELECT *, CASE WHEN kind <> lag(kind, 1, '') OVER (PARTITION BY doc_id ORDER BY p) OR kind IN ('heading', 'bullet') THEN 1 ELSE 0 END AS st FROM k),
 b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM s),
 g AS (SELECT doc_id, b, kind, min(p) AS first, count(*) AS lines, sum(length(line))::BIGINT AS chars FROM b WHERE kind <> 'blank' GROUP BY 1, 2, 3)
 SELECT doc_id, kind, first::INTEGER AS first, lines, chars, row_number() OVER (PARTITION BY doc_id ORDER BY b)::INTEGER AS block FROM g""",
)
def text_observations(spark, sf_dir):
    return E.observations(_docs(spark, sf_dir), "doc_id", "text")


@query(
    "artifact_types",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path, html AS text FROM pages),
 s AS (SELECT page_id, 'article' AS artifact, round(CASE WHEN regexp_matches(path, '^/[^/]*/[^/]*$') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])article(?:$|[^\p{L}\p{N}_])') THEN 1.5 ELSE 0 END, 6) AS score FROM u
  UNION ALL SELECT page_id, 'page', round(CASE WHEN lower(path) LIKE '%.html' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])title') THEN 1.0 ELSE 0 END, 6) FROM u)
 SELECT page_id, artifact, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, artifact)::INTEGER AS rank FROM s WHERE score >= 1.0""",
)
def artifact_types(spark, sf_dir):
    units = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*([^?#]*)", 1).alias("path"), F.lit("text/html").alias("mime"), F.col("html").alias("text"))
    cues = [E.Cue("article", "path_glob", "/*/*", 1.0), E.Cue("article", "cue", "article", 1.5), E.Cue("page", "file_ext", "html", 1.0), E.Cue("page", "cue", "title*", 1.0)]
    return E.artifacts(units, "page_id", cues, 1.0)


_HIT = r"regexp_matches(lower(text), '(?:^|[^\p{{L}}\p{{N}}_]){0}(?:$|[^\p{{L}}\p{{N}}_])')::INT"


@query(
    "sentence_types",
    f"""WITH s AS (SELECT conv_id * 1000 + turn AS id, 1.5::DOUBLE * {_HIT.format("must")} + 1.0 * {_HIT.format("the")} AS requirement, 2.0::DOUBLE * {_HIT.format("i have")} + 0.5 * {_HIT.format("is")} AS statement, 1.0::DOUBLE * {_HIT.format("how")} + 2.0 * regexp_matches(rtrim(text), '\\?["''”’)\\]]*$')::INT AS question FROM conversations),
 u AS (SELECT id, requirement AS score, 'requirement' AS type, 0 AS k FROM s UNION ALL SELECT id, statement, 'statement', 1 FROM s UNION ALL SELECT id, question, 'question', 2 FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, k) AS r, lead(score) OVER (PARTITION BY id ORDER BY score DESC, k) AS second FROM u)
 SELECT id, CASE WHEN score >= 1 THEN type END AS type, CASE WHEN score >= 1 THEN round(greatest(0.05, least(0.95, 0.4 + 0.15 * score - CASE WHEN score - second < 0.5 THEN 0.2 ELSE 0 END)), 4) END::DOUBLE AS confidence FROM r WHERE r = 1""",
)
def sentence_types(spark, sf_dir):
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    cues = [("must", "requirement", 1.5), ("the", "requirement", 1.0), ("i have", "statement", 2.0), ("is", "statement", 0.5), ("how", "question", 1.0)]
    return E.classify(m, "id", "text", cues, ["requirement", "statement", "question"])


@query(
    "remapped_claims",
    """WITH c AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, event_id % 20 AS object, value AS confidence FROM events), k AS (SELECT id, subject - subject % 3 AS subject, predicate, object - object % 3 AS object, confidence FROM c)
 SELECT subject, predicate, object, min(id) AS id, max(confidence) AS confidence, count(*) AS merged FROM k GROUP BY 1, 2, 3""",
)
def remapped_claims(spark, sf_dir):
    return _remap(spark, sf_dir)[0]


@query(
    "superseded_claims",
    """WITH k AS (SELECT event_id AS id, user_id - user_id % 3 AS subject, event_type AS predicate, event_id % 20 - event_id % 20 % 3 AS object FROM events), m AS (SELECT *, min(id) OVER (PARTITION BY subject, predicate, object) AS "by" FROM k)
 SELECT id, "by" FROM m WHERE id <> "by" """,
)
def superseded_claims(spark, sf_dir):
    return _remap(spark, sf_dir)[1]


def _remap(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    claims = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), (F.col("event_id") % 20).alias("object"), F.col("value").alias("confidence"))
    entities = claims.select(F.col("subject").alias("entity")).unionByName(claims.select(F.col("object").alias("entity"))).distinct()
    return E.remapped(claims, entities.select("entity", (F.col("entity") - F.col("entity") % 3).alias("canonical")), ["predicate"])


@query(
    "inferred_facts",
    """WITH RECURSIVE a AS (SELECT DISTINCT l_partkey AS s, l_partkey // 2 AS o FROM lineitem WHERE l_partkey > 0), c AS (SELECT s, o, 1 AS d FROM a UNION ALL SELECT c.s, a.o, d + 1 FROM c JOIN a ON a.s = c.o)
 SELECT s, 'within' AS p, o FROM c UNION ALL SELECT o, 'holds', s FROM c UNION ALL SELECT s, 'part_of', o FROM a""",
)
def inferred_facts(spark, sf_dir):
    """A hierarchy closed under its rules, then inverted in a second stratum."""
    parts = table(spark, sf_dir, "lineitem").where("l_partkey > 0").select(F.col("l_partkey").alias("s"), F.lit("part_of").alias("p"), F.floor(F.col("l_partkey") / 2).alias("o"))
    rules = [E.Rule("within", ("part_of",)), E.Rule("within", ("within", "part_of")), E.Rule("holds", ("~within",), 1)]
    return E.infer(parts, rules).select("s", "p", "o")


@query(
    "missing_properties",
    "WITH c AS (SELECT DISTINCT o_custkey AS node, 'buyer' AS class FROM orders), p AS (SELECT DISTINCT o_custkey AS node, o_orderpriority AS property FROM orders) SELECT node, class, property FROM c CROSS JOIN (VALUES ('1-URGENT'), ('5-LOW')) v(property) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.node = c.node AND p.property = v.property)",
)
def missing_properties(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    facts = o.select(F.col("o_custkey").alias("s"), F.col("o_orderpriority").alias("p"))
    return E.missing_properties(facts, o.select(F.col("o_custkey").alias("node"), F.lit("buyer").alias("class")).distinct(), {"buyer": ["1-URGENT", "5-LOW"]})


@query(
    "area_memberships",
    "WITH p AS (SELECT DISTINCT o_custkey AS unit, o_orderpriority AS entity FROM orders), a(entity, area) AS (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('5-LOW', 'slow')) SELECT unit, area, round(count(*) / (SELECT count(*) FROM p q WHERE q.unit = p.unit), 6) AS share FROM p JOIN a USING (entity) GROUP BY unit, area HAVING share >= 0.5",
)
def area_memberships(spark, sf_dir):
    areas = spark.createDataFrame([("1-URGENT", "fast"), ("2-HIGH", "fast"), ("5-LOW", "slow")], "entity string, area string")
    return E.memberships(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit"), F.col("o_orderpriority").alias("entity")), areas, 0.5)


_ITEM_TERMS = r"t AS (SELECT DISTINCT item_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*'), lambda x: length(x) >= 7)) AS term FROM benchmark)"


def _item_terms(spark, sf_dir):
    words = F.filter(S.word_tokens(F.col("text")), lambda t: F.length(t) >= 7)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(words).alias("term")).distinct()


@query(
    "weighted_similarity",
    f"""WITH {_ITEM_TERMS}, n AS (SELECT count(DISTINCT id) AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), w AS (SELECT id, term, ln(1 + n / df) AS w FROM t JOIN d USING (term) CROSS JOIN n),
 z AS (SELECT id, sum(w) AS z FROM w GROUP BY 1), s AS (SELECT a.id AS i, b.id AS j, sum(a.w) AS both_w FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
 SELECT i, j, round(both_w / (x.z + y.z - both_w), 6) AS score FROM s JOIN z x ON x.id = i JOIN z y ON y.id = j WHERE score >= 0.01""",
)
def weighted_similarity(spark, sf_dir):
    return E.similar_sets(_item_terms(spark, sf_dir), 0.01)


@query(
    "operator_similarity",
    f"""WITH {_ITEM_TERMS}, p AS (SELECT DISTINCT id, left(term, 6) AS term FROM t), z AS (SELECT id, count(*) AS z FROM p GROUP BY 1), s AS (SELECT a.id AS i, b.id AS j, count(*) AS k FROM p a JOIN p b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2)
 SELECT i, j, round(0.5::DOUBLE * k / least(x.z, y.z) + 0.5::DOUBLE * k / (x.z + y.z - k), 6) AS score FROM s JOIN z x ON x.id = i JOIN z y ON y.id = j WHERE score >= 0.02""",
)
def operator_similarity(spark, sf_dir):
    terms = _item_terms(spark, sf_dir).select("id", F.substring("term", 1, 6).alias("term"))
    return E.similar_sets(terms, 0.02, "mean")


@query(
    "operator_reliability",
    "SELECT event_type AS operator, count(*) FILTER (value > 50) AS successes, count(*) FILTER (value <= 50) AS failures, round((count(*) FILTER (value > 50) + 1) / (count(*) + 2), 6) AS reliability FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1",
)
def operator_reliability(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("operator"), (F.col("value") > 50).alias("held"), "ts")
    return E.reliability(runs, "operator", "held", "ts", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@query("judgement_replay", "SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1")
def judgement_replay(spark, sf_dir):
    """A state of the first half of the log, brought up to date with the whole log."""
    j = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("decision"))
    half = j.agg(F.floor(F.max("seq") / 2)).first()[0]
    state = j.where(F.col("seq") <= half).groupBy("user_id").agg(F.max(F.struct("seq", "decision")).alias("x")).select("user_id", "x.seq", "x.decision")
    return E.replay(state, j, "user_id", "seq")


@query(
    "packet_report",
    "SELECT 'dangling' AS problem, o_custkey AS node FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'drift', c_custkey FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'missing', c_custkey FROM customer WHERE c_acctbal <= 0",
)
def packet_report(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    nodes = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("node"), F.col("c_name").alias("body"))
    told = F.when(F.col("c_acctbal") > 9000, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    stated = c.select(F.col("c_custkey").alias("node"), F.sha2(told.cast("binary"), 256).alias("digest"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))
    return E.packet_report(nodes, links, stated, "body")


@query(
    "usage_bands",
    "WITH h AS (SELECT event_type, value, CASE event_type WHEN 'view' THEN 0.5 WHEN 'purchase' THEN 2.0 END::DOUBLE AS price FROM events) SELECT event_type, count(*) AS uses, round(quantile_cont(value, 0.1) * price, 6) AS low, round(quantile_cont(value, 0.5) * price, 6) AS typical, round(quantile_cont(value, 0.9) * price, 6) AS high FROM h GROUP BY event_type, price",
)
def usage_bands(spark, sf_dir):
    price = F.when(F.col("event_type") == "view", 0.5).when(F.col("event_type") == "purchase", 2.0)
    return E.usage_bands(table(spark, sf_dir, "events").withColumn("price", price), "event_type", "value", "price")


@query(
    "import_audit",
    "WITH e AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), i AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' GROUP BY 1) SELECT e.k AS custkey, e.n AS expected, coalesce(i.n, 0) AS imported, CASE WHEN coalesce(i.n, 0) = 0 THEN 'missing' WHEN i.n < e.n THEN 'partial' ELSE 'complete' END AS verdict FROM e LEFT JOIN i USING (k)",
)
def import_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "custkey")
    return E.import_audit(o.groupBy("custkey").agg(F.count("*").alias("n")), o.where("o_orderstatus <> 'P' and o_orderpriority <> '5-LOW'"), "custkey")


@query(
    "item_links",
    f"""WITH {_ITEM_TERMS}, n AS (SELECT count(DISTINCT id) AS n FROM t), d AS (SELECT term, count(*) AS df FROM t GROUP BY 1), w AS (SELECT id, term, ln(1 + n / df) AS w FROM t JOIN d USING (term) CROSS JOIN n),
 z AS (SELECT id, sum(w) AS z FROM w GROUP BY 1), s AS (SELECT a.id AS i, b.id AS j, sum(a.w) AS k FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
 p AS (SELECT i, j, round(k / least(x.z, y.z), 6) AS score FROM s JOIN z x ON x.id = i JOIN z y ON y.id = j WHERE round(k / least(x.z, y.z), 6) >= 0.02),
 m AS (SELECT item_id AS id, item_id % 3 AS type, item_id % 2 AS polarity, item_id % 11 AS date FROM benchmark)
 SELECT CASE WHEN b.date >= a.date THEN j ELSE i END AS source, CASE WHEN b.date >= a.date THEN i ELSE j END AS target, CASE WHEN a.polarity <> b.polarity THEN 'contradicts' ELSE 'supersedes' END AS type, score
 FROM p JOIN m a ON a.id = i JOIN m b ON b.id = j WHERE a.polarity <> b.polarity OR a.type = b.type""",
)
def item_links(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 3).alias("type"), (F.col("item_id") % 2).alias("polarity"), (F.col("item_id") % 11).alias("date"))
    return E.item_links(items, _item_terms(spark, sf_dir), 0.02)


@query(
    "json_mapping",
    "WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n FROM orders) SELECT o_custkey, n::INTEGER AS n, o_orderkey::VARCHAR AS \"key\", CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' THEN 'note,status' ELSE 'note' END AS unavailable, 'extra' AS unknown_fields FROM o",
)
def json_mapping(spark, sf_dir):
    """Orders as JSON lists, mapped back into records."""
    o = table(spark, sf_dir, "orders")
    record = F.struct(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.lit(1).alias("extra"))
    docs = o.groupBy("o_custkey").agg(F.to_json(F.struct(F.sort_array(F.collect_list(record)).alias("items"))).alias("json"))
    rows = E.json_records(docs, "o_custkey", "json", "$.items", {"key": "$.key", "status": "$.status", "note": "$.note"})
    return rows.select("o_custkey", "n", "key", "status", F.array_join(F.sort_array("unavailable"), ",").alias("unavailable"), F.array_join("unknown_fields", ",").alias("unknown_fields"))


@query("principles_found")
def principles_found(spark, sf_dir):
    """Clusters of benchmark items with their support; the tests hold them against brute force."""
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 7).alias("unit"), (F.col("item_id") % 5).alias("date"), F.lit(0.5).alias("confidence"))
    found = E.principles(p, _item_terms(spark, sf_dir), 0.02, 2, 1)
    return E.typed(found, [("broad", F.col("units") >= 4), ("steady", F.col("dates") >= 3)], "local")


@query("project_attribution")
def project_attribution(spark, sf_dir):
    """Benchmark items join a project that starts from one item each; the tests hold it against a plain loop."""
    terms = _item_terms(spark, sf_dir).withColumn("w", F.lit(1.0))
    seeds = terms.select("id").distinct().orderBy("id").limit(2).select("id", F.concat(F.lit("project-"), F.col("id").cast("string")).alias("project"))
    return E.attribute(terms, seeds, 0.02, 0.005)


@query("prefix_terms", r"SELECT item_id, md5(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*'), lambda x: left(x, 6)))), ' ')) AS digest FROM benchmark")
def prefix_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.array_join(F.array_sort(E.prefix_terms(F.col("text"))), " ")).alias("digest"))


@query("two_pass_merge", "SELECT doc_id, CASE WHEN n_chars > 2000 THEN lang ELSE source END AS found, CASE WHEN n_chars > 2000 THEN 2 ELSE 1 END AS pass FROM documents")
def two_pass_merge(spark, sf_dir):
    """A first pass over all units, and a second whose results replace those of the same id."""
    d = _docs(spark, sf_dir)
    first, second = d.select("doc_id", F.col("source").alias("found"), F.lit(1).alias("pass")), d.where("n_chars > 2000").select("doc_id", F.col("lang").alias("found"), F.lit(2).alias("pass"))
    return first.unionByName(second).groupBy("doc_id").agg(F.max(F.struct("pass", "found")).alias("r")).select("doc_id", "r.found", "r.pass")
