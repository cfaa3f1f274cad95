"""Queries of the word, phrase, JSON and secret scalars; their twins hold their own literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import scalars as S
from tidewater.plans.registry import query, table

EN_STOPS = ["the", "and", "of", "in", "is", "to", "that", "with", "for", "this", "was", "are", "from"]
DE_STOPS = ["der", "die", "und", "das", "ist", "den", "mit", "von", "auf", "im"]
_EN = "('the', 'and', 'of', 'in', 'is', 'to', 'that', 'with', 'for', 'this', 'was', 'are', 'from')"
_DE = "('der', 'die', 'und', 'das', 'ist', 'den', 'mit', 'von', 'auf', 'im')"
_WORDS = r"regexp_extract_all(lower(text), '\p{N}*\p{L}[\p{L}\p{N}+#]*')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("word_tokens", f"SELECT doc_id, len({_WORDS})::INTEGER AS words, md5(array_to_string({_WORDS}, ' ')) AS digest FROM documents")
def word_tokens(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", S.word_tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    "content_terms",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS w FROM documents)
 SELECT w AS term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t WHERE length(w) >= 3 AND NOT regexp_full_match(w, '\p{{N}}+') AND w NOT IN {_EN} GROUP BY 1""",
)
def content_terms(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(S.content_tokens(F.col("text"), EN_STOPS)).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    "candidate_phrases",
    rf"""WITH r AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}} \-]+')) AS run, generate_subscripts(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}} \-]+'), 1) AS k FROM documents),
 w AS (SELECT doc_id, k, unnest(list_filter(regexp_split_to_array(run, '[ \-]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(run, '[ \-]+'), lambda x: x <> ''), 1) AS i FROM r),
 c AS (SELECT *, length(w) >= 3 AND NOT regexp_full_match(w, '\p{{N}}+') AND w NOT IN {_EN} AS ok, lead(w) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id, k ORDER BY i)),
 d AS (SELECT *, length(w2) >= 3 AND NOT regexp_full_match(w2, '\p{{N}}+') AND w2 NOT IN {_EN} AS ok2 FROM c)
 SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, w AS term FROM c WHERE ok UNION ALL SELECT doc_id, w || ' ' || w2 FROM d WHERE ok AND ok2 AND w <> w2) GROUP BY 1""",
)
def candidate_phrases(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(S.phrases(F.col("text"), EN_STOPS)).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


_STEM_SQL = r"""CASE WHEN w IN ('data', 'news') OR length(w) < 4 THEN w ELSE
  CASE WHEN r LIKE '%ingly' AND length(r) >= 8 AND regexp_matches(left(r, -5), '[aeiouy]') THEN fix(left(r, -5)) WHEN r LIKE '%edly' AND length(r) >= 7 AND regexp_matches(left(r, -4), '[aeiouy]') THEN fix(left(r, -4))
  WHEN r LIKE '%ing' AND length(r) >= 6 AND regexp_matches(left(r, -3), '[aeiouy]') THEN fix(left(r, -3)) WHEN r LIKE '%ed' AND length(r) >= 5 AND regexp_matches(left(r, -2), '[aeiouy]') THEN fix(left(r, -2))
  WHEN r LIKE '%ly' AND length(r) >= 5 THEN left(r, -2) WHEN r LIKE '%es' AND length(r) >= 5 THEN left(r, -2)
  WHEN r LIKE '%s' AND length(r) >= 4 AND NOT regexp_matches(r, '(ss|us|is)$') THEN left(r, -1) ELSE r END END"""


def _stem_sql() -> str:
    """The stemmer's cases over columns w (word) and r (rewritten word)."""
    import re

    doubled = lambda x: f"right({x}, 1) = substr({x}, length({x}) - 1, 1) AND NOT regexp_matches(right({x}, 1), '[aeiouylsz]')"
    fixed = lambda x: f"(CASE WHEN length({x}) >= 2 AND {doubled(x)} THEN left({x}, -1) WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' ELSE {x} END)"
    return re.sub(r"fix\((left\(r, -\d\))\)", lambda m: fixed(m[1]), _STEM_SQL)


@query(
    "stem_table",
    f"""WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{N}}*\\p{{L}}[\\p{{L}}\\p{{N}}+#]*')) AS w FROM documents),
 x AS (SELECT w, CASE WHEN w LIKE '%ies' AND length(w) >= 5 THEN left(w, -3) || 'y' WHEN w LIKE '%sses' AND length(w) >= 5 THEN left(w, -4) || 'ss' ELSE w END AS r FROM v)
 SELECT w AS word, {_stem_sql()} AS stem FROM x""",
)
def stem_table(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(S.word_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", S.stem(F.col("word")).alias("stem"))


@query(
    "phrase_keys",
    f"""WITH p AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_type || ' finished and polished'), '\\p{{N}}*\\p{{L}}[\\p{{L}}\\p{{N}}+#]*')) AS w, generate_subscripts(regexp_extract_all(lower(p_type || ' finished and polished'), '\\p{{N}}*\\p{{L}}[\\p{{L}}\\p{{N}}+#]*'), 1) AS i FROM part),
 x AS (SELECT p_partkey, i, w, CASE WHEN w LIKE '%ies' AND length(w) >= 5 THEN left(w, -3) || 'y' WHEN w LIKE '%sses' AND length(w) >= 5 THEN left(w, -4) || 'ss' ELSE w END AS r FROM p WHERE w <> 'and'),
 k AS (SELECT p_partkey, string_agg({_stem_sql()}, ' ' ORDER BY i) AS key FROM x GROUP BY 1)
 SELECT p_partkey, regexp_replace(key, '\\bfinish polish\\b', 'surface', 'g') AS key FROM k""",
)
def phrase_keys(spark, sf_dir):
    text = F.concat("p_type", F.lit(" finished and polished"))
    return table(spark, sf_dir, "part").select("p_partkey", S.phrase_key(text, ["and"], glossary={"finish polish": "surface"}).alias("key"))


@query(
    "two_language_guess",
    f"""WITH t AS (SELECT doc_id, {_WORDS} AS t FROM documents),
 n AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x IN {_DE} OR regexp_matches(x, '[äöüß]'))) AS a, len(list_filter(t, lambda x: NOT (x IN {_DE} OR regexp_matches(x, '[äöüß]')) AND x IN {_EN})) AS b,
  len(list_filter(t, lambda x: regexp_matches(x, '[äöüß]'))) AS cue FROM t)
 SELECT doc_id, CASE WHEN n = 0 THEN 'unknown' WHEN n < 4 THEN CASE WHEN cue > 0 THEN 'de' ELSE 'unknown' END WHEN a / n >= 0.08 AND b / n >= 0.08 THEN 'mixed' WHEN a > b AND a / n >= 0.1 THEN 'de' WHEN b / n > 0.1 THEN 'en' ELSE 'unknown' END AS language FROM n""",
)
def two_language_guess(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.guess_lang(F.col("text"), ("de", DE_STOPS, "äöüß"), ("en", EN_STOPS)).alias("language"))


@query("clipped", "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 39) || '…' END AS head FROM documents")
def clipped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.clip(F.col("text"), 40).alias("head"))


@query(
    "utf8_prefixes",
    """WITH p AS (SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 26), lambda k: strlen(substr(text, 1, k)) <= 25))) AS prefix FROM documents)
 SELECT doc_id, length(prefix) AS chars, prefix FROM p""",
)
def utf8_prefixes(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", S.utf8_prefix(F.col("text"), 25).alias("prefix"))
    return rows.select("doc_id", F.length("prefix").cast("long").alias("chars"), "prefix")


@query(
    "cue_phrases",
    r"""SELECT doc_id, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])the license(?:$|[^\p{L}\p{N}_])') AS license, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])distribut') AS distribution, regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])version 2\.0(?:$|[^\p{L}\p{N}_])') AS version FROM documents""",
)
def cue_phrases(spark, sf_dir):
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", S.has_phrase(text, "the license").alias("license"), S.has_phrase(text, "distribut*").alias("distribution"), S.has_phrase(text, "version 2.0").alias("version"))


@query("rendered", "SELECT c_custkey, 'Dear ' || c_name || ' (' || c_mktsegment || '), yours, ' || '.' AS letter FROM customer")
def rendered(spark, sf_dir):
    values = {"name": F.col("c_name"), "segment": F.col("c_mktsegment"), "sender": F.lit(None)}
    return table(spark, sf_dir, "customer").select("c_custkey", S.render("Dear {{name}} ({{segment}}), yours, {{sender}}.", values).alias("letter"))


@query(
    "secret_fields",
    """SELECT event_id, CASE WHEN user_id % 5 = 0 THEN user_id::VARCHAR ELSE '[redacted]' END AS api_token, 'ref' || event_id AS secret_ref,
 CASE WHEN event_type = 'view' THEN '[redacted]' ELSE event_type END AS note FROM events""",
)
def secret_fields(spark, sf_dir):
    token = F.when(F.col("user_id") % 5 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit("t"), F.col("user_id")))
    note = F.when(F.col("event_type") == "view", F.lit("ghp_0123456789abcdefghij")).otherwise(F.col("event_type"))
    fields = F.create_map(F.lit("api_token"), token, F.lit("secret_ref"), F.concat(F.lit("ref"), F.col("event_id")), F.lit("note"), note)
    rows = table(spark, sf_dir, "events").select("event_id", S.redact_secrets(fields).alias("f"))
    return rows.select("event_id", *[F.col("f")[k].alias(k) for k in ("api_token", "secret_ref", "note")])


@query(
    "encoded_data",
    r"""WITH b AS (SELECT doc_id, base64(encode(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'))) AS b, sha256(text) AS h FROM documents), t AS (SELECT doc_id, 'see data:text/plain;base64,' || b || ' and ' || h || ' or ' || b AS text FROM b),
 r AS (SELECT doc_id, text, regexp_replace(text, 'data:[a-zA-Z0-9.+/-]*;base64,[A-Za-z0-9+/]+={0,2}', ' ', 'g') AS rest FROM t),
 u AS (SELECT doc_id, 'data_uri' AS kind, length(split_part(s, ',', -1)) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'data:[a-zA-Z0-9.+/-]*;base64,[A-Za-z0-9+/]+={0,2}')) AS s FROM r)
  UNION ALL SELECT doc_id, 'base64', length(s) FROM (SELECT doc_id, unnest(regexp_extract_all(rest, '[A-Za-z0-9+/]{40,}={0,2}')) AS s FROM r) WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]')
  UNION ALL SELECT doc_id, 'hex', length(s) FROM (SELECT doc_id, unnest(regexp_extract_all(rest, '\b(?:[0-9a-f]{2}){16,}\b')) AS s FROM r))
 SELECT doc_id, kind, count(*) AS n, sum(chars)::BIGINT AS chars FROM u GROUP BY ALL""",
)
def encoded_data(spark, sf_dir):
    plain = F.regexp_replace("text", "[^a-zA-Z0-9 ]", "")
    code = F.replace(F.base64(F.encode(plain, "utf-8")), F.lit("\r\n"), F.lit(""))
    text = F.concat(F.lit("see data:text/plain;base64,"), code, F.lit(" and "), F.sha2(F.col("text").cast("binary"), 256), F.lit(" or "), code)
    found = _docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", F.explode(S.encoded_spans(F.col("t"))).alias("s"))
    return found.groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum("s.chars").alias("chars"))


@query("pointer_names", "SELECT doc_id, '/' || replace(replace(source || '/' || lang || '~' || doc_id, '~', '~0'), '/', '~1') AS pointer FROM documents")
def pointer_names(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("/"), S.pointer_escape(F.concat("source", F.lit("/"), "lang", F.lit("~"), F.col("doc_id")))).alias("pointer"))


@query("platform_shapes", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('purchase', 'view')) AS shaped FROM events GROUP BY 1")
def platform_shapes(spark, sf_dir):
    """Elements that hold a key of every group."""
    keys = F.array_append(F.json_object_keys("props"), F.col("event_type"))
    shaped = S.key_groups(keys, [["k", "id"], ["purchase", "view"]])
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(shaped).alias("shaped"))


_PATCH = """'{"k": null, "meta": {"type": "' || event_type || '", "user": ' || user_id || '}}'"""


@query(
    "json_patches",
    f"""WITH p AS (SELECT event_id, json_merge_patch(props::JSON, ({_PATCH})::JSON) AS patched FROM events)
 SELECT event_id, patched->>'$.meta.type' AS type, (patched->>'$.meta.user')::BIGINT AS user_id, patched->>'$.k' IS NULL AS dropped, len(json_keys(patched))::INTEGER AS members FROM p""",
)
def json_patches(spark, sf_dir):
    patch = F.concat(F.lit('{"k": null, "meta": {"type": "'), "event_type", F.lit('", "user": '), F.col("user_id").cast("string"), F.lit("}}"))
    rows = table(spark, sf_dir, "events").select("event_id", S.merge_patch(F.col("props"), patch).alias("p"))
    at = lambda path: F.get_json_object("p", path)
    return rows.select("event_id", at("$.meta.type").alias("type"), at("$.meta.user").cast("long").alias("user_id"), at("$.k").isNull().alias("dropped"), F.size(F.json_object_keys("p")).alias("members"))


@query("json_canonical")
def json_canonical(spark, sf_dir):
    """Equal JSON values by their canonical form; the tests compare it with the library."""
    return table(spark, sf_dir, "events").groupBy(S.canonical_json(F.col("props")).alias("canonical")).agg(F.count("*").alias("n"))


@query("sentence_split")
def sentence_split(spark, sf_dir):
    """The tests hold the sentences against literal expectations."""
    rows = _docs(spark, sf_dir).select("doc_id", S.sentences(F.col("text"), ["e.g", "dr", "mr"]).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "\n")).alias("digest"))
