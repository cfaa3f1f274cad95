"""Queries of the message, claim and link stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.operators import knowledge as K
from tidewater.plans.registry import query, table


def _messages(spark, sf_dir):
    """Conversations as a message store: id in order of writing, inactive where the system speaks."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "conv_id", "turn", "role", "text", (F.col("role") != "system").alias("active"))


_MSG = "m AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, role, text, role <> 'system' AS active FROM conversations)"


def _claims(spark, sf_dir):
    """Events as claims: a user (subject) did something (predicate) worth a value; errors are guesses."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.floor("value").cast("long").alias("object"),
        F.when(F.col("event_type") == "error", "guess").when(F.col("event_type") == "purchase", "record").otherwise("statement").alias("evidence"),
        F.round(F.lit(1.0) / (1 + F.pmod("event_id", F.lit(7))), 6).alias("confidence"), (F.col("event_id") % 50).alias("observation"),
    )


_CLAIMS = """c AS (SELECT event_id AS id, user_id AS subject, event_type AS predicate, floor(value)::BIGINT AS object,
 CASE event_type WHEN 'error' THEN 'guess' WHEN 'purchase' THEN 'record' ELSE 'statement' END AS evidence, round(1.0::DOUBLE / (1 + event_id % 7), 6) AS confidence, event_id % 50 AS observation FROM events)"""


@query("conversation_list", "SELECT conv_id, max(conv_id * 1000 + turn) AS updated, count(*) AS messages FROM conversations GROUP BY 1 ORDER BY updated DESC, conv_id LIMIT 50")
def conversation_list(spark, sf_dir):
    rows = _messages(spark, sf_dir).groupBy("conv_id").agg(F.max("msg_id").alias("updated"), F.count("*").alias("messages"))
    return rows.orderBy(F.desc("updated"), "conv_id").limit(50)


@query("conversation_messages", f"WITH {_MSG} SELECT msg_id, role, text FROM m WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND active")
def conversation_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    first = m.agg(F.min("conv_id")).first()[0]
    return K.messages_of(m, F.col("conv_id") == first, F.col("active"), False, "turn").select("msg_id", "role", "text")


@query("message_counts", f"WITH {_MSG} SELECT role, count(*) AS messages, count(*) FILTER (active) AS active, count(*) FILTER (active AND length(text) >= 20) AS pending FROM m GROUP BY 1")
def message_counts(spark, sf_dir):
    rows = _messages(spark, sf_dir).groupBy("role")
    return rows.agg(F.count("*").alias("messages"), F.count_if("active").alias("active"), F.count_if(F.col("active") & (F.length("text") >= 20)).alias("pending"))


@query("unanalysed_messages", f"WITH {_MSG} SELECT msg_id FROM m WHERE active AND length(text) >= 20 AND msg_id > 2000 AND msg_id NOT IN (SELECT msg_id FROM m WHERE turn = 1) ORDER BY msg_id LIMIT 100")
def unanalysed_messages(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return K.pending(m, F.col("active") & (F.length("text") >= 20), m.where("turn = 1"), "msg_id", 2000, 100, "msg_id").select("msg_id")


def _nodes(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations = n.select((F.col("n_nationkey") + 100).cast("long").alias("node"), F.lit("nation").alias("kind"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("long").alias("created"))
    return nations.unionByName(r.select(F.col("r_regionkey").cast("long").alias("node"), F.lit("region").alias("kind"), F.col("r_name").alias("label"), F.col("r_regionkey").cast("long").alias("created")))


_NODES = "g AS (SELECT (n_nationkey + 100)::BIGINT AS node, 'nation' AS kind, n_name AS label, n_nationkey::BIGINT AS created FROM nation UNION ALL SELECT r_regionkey::BIGINT, 'region', r_name, r_regionkey::BIGINT FROM region)"


@query("node_list", f"WITH {_NODES} SELECT * FROM g WHERE kind = 'nation' ORDER BY created DESC, node LIMIT 12")
def node_list(spark, sf_dir):
    return K.nodes(_nodes(spark, sf_dir), kind="nation", limit=12)


@query("node_by_label", f"WITH {_NODES} SELECT * FROM g WHERE label = (SELECT min(r_name) FROM region) AND kind = 'region'")
def node_by_label(spark, sf_dir):
    label = table(spark, sf_dir, "region").agg(F.min("r_name")).first()[0]
    return K.nodes(_nodes(spark, sf_dir), label=label, kind="region")


@query("perspective_nodes", f"WITH {_NODES} SELECT node, kind, label FROM g WHERE (kind IN ('nation') AND contains(lower(label), 'an')) OR node = 1")
def perspective_nodes(spark, sf_dir):
    seeds = spark.createDataFrame([(1,)], "node long")
    return K.perspective_nodes(_nodes(spark, sf_dir), ["nation"], ["hidden"], "AN", seeds).select("node", "kind", "label")


def _base(spark, sf_dir):
    c = _claims(spark, sf_dir)
    return K.KnowledgeBase(
        {"claims": c, "entities": c.select(F.col("subject").alias("id")).distinct()}, {"claims": ["subject", "predicate", "object", "evidence"]}, c.select(F.col("id").alias("claim"), "observation")
    )


@query("kb_claims", f"WITH {_CLAIMS} SELECT id, subject, predicate, object, confidence FROM c WHERE predicate IN ('purchase', 'view') AND evidence = 'record' AND observation = 17 ORDER BY id LIMIT 100")
def kb_claims(spark, sf_dir):
    rows = _base(spark, sf_dir).query("claims", observation=17, predicate=["purchase", "view"], evidence="record")
    return rows.select("id", "subject", "predicate", "object", "confidence")


@query("kb_entities", f"WITH {_CLAIMS} SELECT DISTINCT subject AS id FROM c ORDER BY 1 LIMIT 100")
def kb_entities(spark, sf_dir):
    return _base(spark, sf_dir).query("entities")


@query("evidence_admission", f"WITH {_CLAIMS} SELECT subject, count(*) AS claims, (SELECT count(*) FROM c WHERE evidence = 'guess') AS filtered FROM c WHERE evidence IN ('record', 'statement') GROUP BY 1")
def evidence_admission(spark, sf_dir):
    kept, counts = K.admit(_claims(spark, sf_dir), "evidence", ["record", "statement"])
    return kept.groupBy("subject").agg(F.count("*").alias("claims")).join(F.broadcast(counts.select("filtered")))


def _notes(spark, sf_dir):
    """Events as annotation revisions: one id per user and type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat_ws(":", "user_id", "event_type").alias("id"), F.col("event_id").alias("revision"), (F.col("value") < 80).alias("active"), "value", (F.col("user_id") * 1000).alias("msg_id"))


@query(
    "annotation_page",
    """WITH a AS (SELECT user_id || ':' || event_type AS id, event_id AS revision, value < 80 AS active, value FROM events),
 l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY revision DESC) = 1) SELECT id, revision, value FROM l WHERE active AND id > '10' ORDER BY id LIMIT 25""",
)
def annotation_page(spark, sf_dir):
    rows = K.latest(_notes(spark, sf_dir).drop("msg_id"), "id", "revision")
    return rows.where("active and id > '10'").orderBy("id").limit(25).select("id", "revision", "value")


@query(
    "changed_documents",
    "SELECT doc_id, length(text) AS old_size, length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS new_size FROM documents WHERE length(text) <> length(trim(regexp_replace(text, '\\s+', ' ', 'g')))",
)
def changed_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.select("doc_id", F.length(F.trim(F.regexp_replace("text", r"\s+", " "))).cast("long").alias("size"))
    return K.changed(d.select("doc_id", F.length("text").cast("long").alias("size")), new, "doc_id", "size")


@query(
    "annotation_sources",
    f"""WITH {_MSG}, a AS (SELECT DISTINCT user_id * 1000 AS msg_id FROM events), {_NODES} SELECT a.msg_id, m.role, m.msg_id IS NOT NULL AS known, EXISTS (SELECT 1 FROM g WHERE node = a.msg_id / 1000) AS node_exists FROM a LEFT JOIN m ON m.msg_id = a.msg_id""",
)
def annotation_sources(spark, sf_dir):
    """Left outer join with flags of what exists."""
    a = _notes(spark, sf_dir).select("msg_id").distinct()
    m = _messages(spark, sf_dir).select("msg_id", "role", F.lit(True).alias("_m"))
    g = _nodes(spark, sf_dir).select((F.col("node") * 1000).alias("msg_id"), F.lit(True).alias("_g"))
    return a.join(m, "msg_id", "left").join(g, "msg_id", "left").select("msg_id", "role", F.col("_m").isNotNull().alias("known"), F.col("_g").isNotNull().alias("node_exists"))


@query("order_line_bytes", "SELECT o_orderkey, (SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM orders")
def order_line_bytes(spark, sf_dir):
    """A correlated scalar sum, decorrelated by the optimizer."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("_lineitem")
    return spark.sql("SELECT o_orderkey, (SELECT sum(l_quantity) FROM _lineitem WHERE l_orderkey = o_orderkey) AS quantity FROM _orders")


@query("project_siblings", "SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_nationkey FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey AND s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) <= 32)")
def project_siblings(spark, sf_dir):
    return K.siblings(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey")[0]


@query("project_groups", "SELECT c_nationkey, count(*) AS units FROM customer GROUP BY 1 HAVING count(*) > 32")
def project_groups(spark, sf_dir):
    return K.siblings(table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")[1]


@query(
    "version_near_alias",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) AS at FROM documents)
 SELECT DISTINCT v.doc_id, v.at FROM w v JOIN w a ON a.doc_id = v.doc_id AND abs(a.at - v.at) <= 12 WHERE v.w = 'version' AND a.w = 'license'""",
)
def version_near_alias(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0)
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("p", "w")).select("doc_id", "w", (F.col("p") + 1).cast("long").alias("at"))
    return K.near_tokens(w.where("w = 'version'").select("doc_id", "at"), w.where("w = 'license'").select("doc_id", "at"), "doc_id", "at", 12)


@query(
    "linked_units",
    """WITH u AS (SELECT doc_id, md5(text) AS attachment, source AS project, regexp_extract(text, '(https?://[a-z.]+)', 1) AS url FROM documents), s AS (SELECT * FROM u WHERE doc_id < 5),
 r AS (SELECT doc_id, 0 AS k, 'attachment' AS reason FROM u WHERE attachment IN (SELECT attachment FROM s) UNION ALL SELECT doc_id, 1, 'project' FROM u WHERE project IN (SELECT project FROM s)
  UNION ALL SELECT doc_id, 2, 'url' FROM u WHERE url IN (SELECT url FROM s WHERE url <> ''))
 SELECT doc_id, arg_min(reason, k) AS reason, count(*) AS reasons FROM r WHERE doc_id >= 5 GROUP BY 1""",
)
def linked_units(spark, sf_dir):
    url = F.nullif(F.regexp_extract("text", "(https?://[a-z.]+)", 1), F.lit(""))
    u = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("attachment"), F.col("source").alias("project"), url.alias("url"))
    return K.linked(u, u.where("doc_id < 5"), "doc_id", {"attachment": "attachment", "project": "project", "url": "url"})


@query(
    "merged_claims",
    f"""WITH {_CLAIMS} SELECT subject, predicate, object, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(observation))), ',') AS support, count(*) AS merged FROM c GROUP BY ALL""",
)
def merged_claims(spark, sf_dir):
    c = _claims(spark, sf_dir).withColumn("support", F.array("observation"))
    merged = K.merge_claims(c, ["subject", "predicate", "object"], "confidence", "support")
    return merged.withColumn("support", F.array_join(F.col("support").cast("array<string>"), ","))


def _two_channels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ranked = lambda rows: rows.select("doc_id", F.row_number().over(_by("doc_id")).alias("rank"))
    return ranked(d.where(F.contains(F.lower("text"), F.lit("license"))).orderBy("doc_id").limit(40)), ranked(d.orderBy(F.desc("n_chars"), "doc_id").limit(40))


def _by(*columns):
    from pyspark.sql import Window

    return Window.orderBy(*columns)


_CHANNELS = """a AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 40)),
 b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40))"""


@query(
    "channel_union",
    f"""WITH {_CHANNELS}, x AS (SELECT doc_id, rank, 0 AS k, 'lexical' AS channel FROM a UNION ALL SELECT doc_id, rank, 1, 'length' FROM b)
 SELECT doc_id, channel, rank::INTEGER AS rank FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1) ORDER BY k, rank, doc_id LIMIT 50""",
)
def channel_union(spark, sf_dir):
    lexical, length = _two_channels(spark, sf_dir)
    return K.first_of_channels([("lexical", lexical), ("length", length)], "doc_id", 50)


@query("shadow_gap", f"WITH {_CHANNELS} SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b")
def shadow_gap(spark, sf_dir):
    """Lexical hits that the primary channel doesn't have."""
    lexical, length = _two_channels(spark, sf_dir)
    return K.sides(lexical, length, "doc_id", ("gap", "primary", "both")).where("side = 'gap'").select("doc_id")


@query("channel_sides", f"WITH {_CHANNELS} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'lexical_only' WHEN a.doc_id IS NULL THEN 'vectors_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id")
def channel_sides(spark, sf_dir):
    return K.sides(*_two_channels(spark, sf_dir), "doc_id", ("lexical_only", "vectors_only", "both"))


@query(
    "hits_with_counts",
    "WITH s AS (SELECT doc_id, (length(text) - length(replace(lower(text), 'license', ''))) / 7.0::DOUBLE AS score FROM documents) SELECT doc_id, score, (SELECT count(*) FROM s WHERE score > 0) AS eligible, (SELECT count(*) FROM s WHERE score = 0) AS zero, (SELECT count(*) FROM s WHERE score > 0) > 10 AS truncated FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10",
)
def hits_with_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    score = (F.length("text") - F.length(F.replace(F.lower("text"), F.lit("license"), F.lit("")))) / F.lit(7.0)
    return K.hits(d.select("doc_id", score.alias("score")), "doc_id", 0.0, 10)


@query("timeline_order", "SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN n_chars < 500 THEN NULL ELSE n_chars END NULLS LAST, source, lang, doc_id)::INTEGER AS place FROM documents QUALIFY place <= 200")
def timeline_order(spark, sf_dir):
    """Rows without a time last, then by service, archive and locator: the first 200 of a total order."""
    d = table(spark, sf_dir, "documents").withColumn("t", F.when(F.col("n_chars") >= 500, F.col("n_chars")))
    first = d.orderBy(F.asc_nulls_last("t"), "source", "lang", "doc_id").limit(200)
    return first.select("doc_id", F.row_number().over(_by(F.asc_nulls_last("t"), "source", "lang", "doc_id")).alias("place"))


@query(
    "ordered_children",
    "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey)::INTEGER AS place FROM orders",
)
def ordered_children(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("kind", F.col("o_orderpriority"))
    return K.ranked_children(o, "o_custkey", ["1-URGENT", "2-HIGH"], F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "place")


@query(
    "thesis_budgets",
    """WITH t AS (SELECT lang, count(DISTINCT source) AS w FROM documents GROUP BY 1), s AS (SELECT lang, w, sum(w) OVER (ORDER BY lang) AS s, sum(w) OVER () AS a FROM t),
 b AS (SELECT lang, floor(20000 * s / a)::BIGINT - floor(20000 * (s - w) / a)::BIGINT AS share FROM s),
 i AS (SELECT doc_id, lang, sum(ceil(n_chars / 4)::BIGINT) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::BIGINT AS spent FROM documents)
 SELECT doc_id, lang, spent, share FROM i JOIN b USING (lang) WHERE spent <= share""",
)
def thesis_budgets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("cost", F.ceil(F.col("n_chars") / 4))
    weights = d.groupBy("lang").agg(F.countDistinct("source").alias("w"))
    return K.weighted_budgets(d.join(F.broadcast(weights), "lang"), "lang", "w", "cost", 20_000, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "lang", "spent", "share")


@query(
    "optimistic_revisions",
    """WITH l AS (SELECT user_id, count(*) AS latest FROM events WHERE event_type = 'view' GROUP BY 1), e AS (SELECT event_id AS edit, user_id, (event_id % 40)::BIGINT AS expected FROM events WHERE event_type = 'purchase'),
 j AS (SELECT edit, e.user_id, expected, coalesce(latest, 0) AS latest FROM e LEFT JOIN l USING (user_id)),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN expected = latest THEN 0 ELSE 1 END, edit) = 1 AND expected = latest AS ok FROM j)
 SELECT user_id, edit, expected, latest FROM k WHERE NOT ok""",
)
def optimistic_revisions(spark, sf_dir):
    """Edits that lost against the store's latest revision."""
    e = table(spark, sf_dir, "events")
    store = e.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("revision"), F.max("event_id").alias("edit"))
    edits = e.where("event_type = 'purchase'").select(F.col("event_id").alias("edit"), "user_id", (F.col("event_id") % 40).alias("expected"))
    return K.revise(store, edits, "user_id", "revision")[1]


@query("blank_messages", "SELECT conv_id, count(*) FILTER (trim(text) <> '') AS kept, count(*) FILTER (trim(text) = '') AS blank FROM conversations GROUP BY 1")
def blank_messages(spark, sf_dir):
    """What a batch insert takes and what it skips."""
    blank = F.trim("text") == ""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(~blank).alias("kept"), F.count_if(blank).alias("blank"))


@query("working_copy", "SELECT 'region' AS name, r_regionkey::BIGINT AS id, md5('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}') AS digest FROM region UNION ALL SELECT 'nation', n_nationkey, md5('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}') FROM nation")
def working_copy(spark, sf_dir):
    """A table subset as portable JSON rows."""
    bundle = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("name"), F.col(key).cast("long").alias("id"), F.to_json(F.struct("*")).alias("row"))
    return bundle("region", "r_regionkey").unionByName(bundle("nation", "n_nationkey")).select("name", "id", F.md5("row").alias("digest"))


@query("mention_keys", "SELECT doc_id, regexp_matches(lower(text), 'license') AS mentioned FROM documents")
def mention_keys(spark, sf_dir):
    """Documents whose match keys hold one of a project's keys."""
    keys = S.word_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(keys, lambda t: F.contains(t, F.lit("license"))).alias("mentioned"))
