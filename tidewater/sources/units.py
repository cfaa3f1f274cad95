"""From files to catalogue units: which files count, what platform an export is of, its text, its versions, and how to read and
write parts of it by locator."""

from __future__ import annotations

import io
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.scalars import key_groups
from tidewater.functions.text import let
from tidewater.sources import readers

ARCHIVES = r"(?i)\.(zip|tar|gz|tgz|7z|rar)$"
#: Platform -> groups of member names: an element is of the platform if it has a member of every group.
PLATFORMS = {
    "tree": [["mapping"], ["title", "current_node"]],
    "linear": [["chat_messages"], ["uuid", "name"]],
    "session": [["sessionId"], ["message", "type"]],
    "activity": [["header"], ["time"], ["title", "titleUrl"]],
    "responses": [["responses"], ["conversation"]],
    "messages": [["role", "author", "sender"], ["content", "text", "parts"]],
}


def walk(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder that count, in order of path: none that begin with a dot or lie in such a folder or in ``__MACOSX``, no
    archives."""
    found = readers.files(spark, path)
    inside = F.replace(F.col("path"), F.lit(path.rstrip("/")), F.lit(""))
    return found.where(~inside.rlike(r"/(\.|__MACOSX)") & ~F.col("path").rlike(ARCHIVES)).orderBy("path")


def platform(element: Column) -> Column:
    """Platform of one JSON element; null if it has the shape of none."""

    def of(keys: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, groups in reversed(PLATFORMS.items()):
            out = F.when(key_groups(keys, groups), name).otherwise(out)
        return out

    return let(F.json_object_keys(element), of)


def whole_units(found: DataFrame, sample: int = 4 << 20) -> DataFrame:
    """A unit per file: path, digest of all bytes, size, and the beginning as text."""
    return found.select("path", F.sha2("content", 256).alias("digest"), F.col("length").alias("bytes"), F.decode(F.substring("content", 1, sample), "UTF-8").alias("sample"))


def extracted(texts: DataFrame, id_col: str, text: str, head: int = 200) -> DataFrame:
    """Text of a unit apart: prose and fenced code, their sizes, number of code blocks, and the first characters of the prose."""
    parts = F.split(text, "```")
    pick = lambda odd: F.array_join(F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == odd, p)), lambda p: p.isNotNull()), "\n")
    rows = texts.select(id_col, pick(0).alias("prose"), pick(1).alias("code"), F.floor(F.size(parts) / 2).alias("blocks"))
    return rows.select(id_col, "prose", "code", "blocks", F.length("prose").cast("long").alias("prose_chars"), F.length("code").cast("long").alias("code_chars"), F.substring("prose", 1, head).alias("head"))


def scan(units: DataFrame, catalogue: DataFrame) -> DataFrame:
    """What a scan does with units (platform, ext_id, created, digest) given those known: ``duplicate`` if the digest is known or came
    before in the scan, ``version`` of the newest earlier unit of the same platform and id, else ``new``."""
    both = units.withColumn("_new", F.lit(1)).unionByName(catalogue.withColumn("_new", F.lit(0)))
    by_digest = Window.partitionBy("digest").orderBy("_new", "created", "platform", "ext_id")
    copy = both.withColumn("_copy", F.row_number().over(by_digest) > 1)
    chain = Window.partitionBy("platform", "ext_id").orderBy("_new", "created", "digest")
    kept = copy.where("not _copy").withColumn("previous", F.lag("digest").over(chain)).withColumn("_n", F.row_number().over(chain))
    out = kept.where("_new = 1").select("platform", "ext_id", "created", "digest", F.when(F.col("previous").isNull(), "new").otherwise("version").alias("state"), "previous", F.col("_n").alias("version_num"))
    copies = copy.where("_copy and _new = 1").select("platform", "ext_id", "created", "digest", F.lit("duplicate").alias("state"), F.lit(None).cast("string").alias("previous"), F.lit(None).cast("int").alias("version_num"))
    return out.unionByName(copies)


FULL = "path string, conversation string, id string, parent string, role string, text string, attachments array<string>, unknown string, error string"


def full_messages(df: DataFrame) -> DataFrame:
    """Every message of chat exports without loss: all branches with their parents, names of attachments, and what no field takes as
    JSON. Message trees, sender lists, session lines (JSONL), activity lists and response lists are read."""

    def text_of(value) -> str:
        if isinstance(value, list):
            return "\n".join(filter(None, (text_of(v) for v in value)))
        if isinstance(value, dict):
            return text_of(value.get("parts") or value.get("text") or value.get("content") or "")
        return value if isinstance(value, str) else ""

    def message(conversation, key, parent, role, body, rest) -> dict:
        files = [str(a.get("file_name") or a.get("name") or a.get("id")) for a in rest.pop("attachments", None) or rest.pop("files", None) or [] if isinstance(a, dict)]
        return {"conversation": conversation, "id": key and str(key), "parent": parent and str(parent), "role": role, "text": text_of(body), "attachments": files, "unknown": json.dumps(rest, sort_keys=True, default=str) if rest else None}

    def tree(name: str, value: dict):
        for key, node in value["mapping"].items():
            m = dict(node.get("message") or {})
            author = m.pop("author", None) or {}
            yield message(name, key, node.get("parent"), author.get("role"), m.pop("content", None), m)

    def linear(name: str, items: list):
        before = None
        for k, item in enumerate(items):
            m = dict(item)
            key = m.pop("uuid", None) or m.pop("id", None) or str(k)
            parent = m.pop("parent_message_uuid", None) or m.pop("parentUuid", None) or before
            role = m.pop("sender", None) or m.pop("role", None)
            content = m.pop("content", None)
            yield message(name, key, parent, role, m.pop("text", None) or content, m)
            before = key

    def element(name: str, value):
        if isinstance(value, dict) and isinstance(value.get("mapping"), dict):
            yield from tree(value.get("title") or name, value)
        elif isinstance(value, dict) and isinstance(value.get("responses"), list):
            yield from linear(str((value.get("conversation") or {}).get("title") or name), [r.get("response", r) for r in value["responses"]])
        elif isinstance(value, dict) and isinstance(value.get("chat_messages"), list):
            yield from linear(value.get("name") or value.get("uuid") or name, value["chat_messages"])
        elif isinstance(value, dict) and isinstance(value.get("messages"), list):
            yield from linear(value.get("title") or name, value["messages"])
        elif isinstance(value, dict) and "sessionId" in value and isinstance(value.get("message"), dict):
            inner = dict(value["message"])
            yield message(value["sessionId"], value.get("uuid"), value.get("parentUuid"), inner.pop("role", value.get("type")), inner.pop("content", None), inner)
        elif isinstance(value, dict) and "header" in value and "time" in value:
            rest = {k: v for k, v in value.items() if k not in ("title", "header")}
            yield message(str(value["header"]), value["time"], None, "user", value.get("title"), rest)
        elif isinstance(value, dict):
            yield from linear(name, [value])

    def parse(path: str, content: bytes):
        text = content.decode("utf-8-sig")
        start = text.find("[") if text.lstrip().startswith(("window.", "var ", "const ")) else 0  # a script that wraps its data
        try:
            data = json.loads(text[start:].rstrip().rstrip(";"))
        except ValueError:
            data = [json.loads(line) for line in text.splitlines() if line.strip()]
        for k, value in enumerate(data if isinstance(data, list) else [data]):
            yield from element(str(k), value)

    return readers._per_file(df, parse, FULL)


TREE = "path string, container string, member string, bytes long, sha256 string, kind string, error string"


def containers(df: DataFrame) -> DataFrame:
    """Files and members of zips, also of zips in them: container chain, digest and kind by name or first signs."""

    def kind(name: str, head: bytes) -> str:
        ending = name.rsplit(".", 1)[-1].lower() if "." in name else ""
        if ending in readers.ENDINGS:
            return readers.ENDINGS[ending]
        lead = head[:200].lstrip()
        return "zip" if head[:4] == b"PK\x03\x04" else "sqlite" if head[:15] == b"SQLite format 3" else "html" if lead[:5].lower() in (b"<html", b"<!doc") else "json" if lead[:1] in (b"{", b"[") else "text"

    def parse(path: str, content: bytes):
        import hashlib
        import zipfile

        stack = [("", path, content)]
        while stack:
            chain, name, body = stack.pop()
            what = kind(name, body)
            yield {"container": chain, "member": name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "kind": what}
            if what == "zip" and chain.count("!") < 3:
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    stack += [(f"{chain}{name}!", i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and ".." not in i.filename.split("/") and not i.filename.startswith(("/", "__MACOSX"))]

    return readers._per_file(df, parse, TREE)


def zip_messages(df: DataFrame, read: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Messages of the members of zip archives, each by the reader of its format; members that no reader takes, or that fail, are
    rows with an error."""
    members = readers.zip_members(df).select(F.concat_ws("!", "path", "member").alias("path"), "content", "error")
    formats = read or {"json": readers.json_messages, "html": readers.html_messages, "mht": readers.mht_parts, "sqlite": readers.sqlite_messages}
    known = members.withColumn("_f", readers.detect_format(F.col("path"), F.col("content")))
    out = [reader(known.where(F.col("_f") == name)) for name, reader in formats.items()]
    names = [c.split()[0] for c in readers.MESSAGES.split(", ")]
    rest = known.where(~F.col("_f").isin(list(formats)) | F.col("error").isNotNull())
    lost = rest.select("path", *[F.lit(None).cast("long" if c == "position" else "string").alias(c) for c in names[1:-1]], F.coalesce("error", F.concat(F.lit("no reader for "), "_f")).alias("error"))
    for part in out:
        lost = lost.unionByName(part.select(*names))
    return lost


PARSED = "path string, format string, canonical string, error string"


def strict_documents(df: DataFrame, most_bytes: int = 16 << 20, most_depth: int = 64) -> DataFrame:
    """JSON, XML and CSV files as canonical JSON within budgets of size and depth; duplicate members, NaN and infinities are errors."""

    def unique(pairs):
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("a member occurs twice")
        return out

    def refuse(name):
        raise ValueError(f"{name} is no JSON number")

    def depth(value, left: int) -> None:
        if left < 0:
            raise ValueError("too deep")
        for inner in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
            depth(inner, left - 1)

    def element(node) -> dict:
        return {"tag": node.tag, "attributes": dict(node.attrib), "text": (node.text or "").strip(), "children": [element(c) for c in node]}

    def parse(path: str, content: bytes):
        import csv
        from xml.etree import ElementTree

        if len(content) > most_bytes:
            raise ValueError("too large")
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "json":
            value = json.loads(content, object_pairs_hook=unique, parse_constant=refuse)
        elif kind == "xml":
            if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
                raise ValueError("document types and entities aren't read")
            value = element(ElementTree.fromstring(content))
        elif kind == "csv":
            rows = list(csv.reader(io.StringIO(content.decode())))
            if rows and len(set(rows[0])) != len(rows[0]):
                raise ValueError("a column occurs twice")
            value = [dict(zip(rows[0], r, strict=True)) for r in rows[1:]]
        else:
            raise ValueError(f"no parser for {kind}")
        depth(value, most_depth)
        yield {"format": kind, "canonical": json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)}

    return readers._per_file(df, parse, PARSED)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by number from 0: (path, line, body). Files are split by Spark; numbers are offsets of counted parts."""
    from tidewater.workspace import materialize

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_m"), F.col("value").alias("body"))
    stored = materialize(raw)
    sizes = stored.groupBy("path", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return stored.join(before, ["path", "_block"]).select("path", (F.col("_before") + F.col("_m") - F.col("_first")).alias("line"), "body")


def at_pointer(rows: DataFrame, pointer: str) -> DataFrame:
    """The value at a pointer whose first part is a line number and the rest a path of member names and places."""
    first, *rest = [p.replace("~1", "/").replace("~0", "~") for p in pointer.strip("/").split("/")]
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in rest)
    return rows.where(F.col("line") == int(first)).select("path", "line", F.get_json_object("body", path).alias("value"))


def registered(registry: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """A registry with new entries; an entry that is there stays as it is."""
    fresh = new.join(registry.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min(F.struct(at, *[c for c in fresh.columns if c not in (key, at)])).alias("_r"))
    return registry.unionByName(first.select(key, "_r.*").select(*registry.columns))


def import_plan(units: DataFrame, selected: DataFrame, unit: str, group: str, at: str, seconds: int, siblings: bool = True) -> DataFrame:
    """Units to import, each with its first reason: selected, sibling (same group), or within the time window of a selected one.
    The window joins by stretches of its length, so only near ones meet."""
    chosen = units.join(selected.select(unit), unit, "left_semi")
    parts = [chosen.select(unit, F.lit(0).alias("_k"))]
    if siblings:
        parts.append(units.join(chosen.select(group).distinct(), group, "left_semi").select(unit, F.lit(1).alias("_k")))
    stamp = F.unix_timestamp(F.col(at).cast("timestamp"))
    near = chosen.select(stamp.alias("_t"), F.explode(F.array(*[F.floor(stamp / seconds) + d for d in (-1, 0, 1)])).alias("_s")).distinct()
    timed = units.select(unit, stamp.alias("_u"), F.floor(stamp / seconds).alias("_s"))
    parts.append(timed.join(near, (timed["_s"] == near["_s"]) & (F.abs(F.col("_u") - F.col("_t")) <= seconds), "left_semi").select(unit, F.lit(2).alias("_k")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    reason = F.element_at(F.array(F.lit("selected"), F.lit("sibling"), F.lit("window")), F.min("_k") + 1)
    return union.groupBy(unit).agg(reason.alias("reason"))


def blob_sha(content: Column) -> Column:
    """Digest of a file as version control names it."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"), content))


def sync_status(base: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Three-way state of each path by digest (path, sha): same, push, pull, conflict, and what was deleted on one side."""
    joined = base.select("path", F.col("sha").alias("b")).join(here.select("path", F.col("sha").alias("h")), "path", "full").join(there.select("path", F.col("sha").alias("t")), "path", "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    state = F.when(same("h", "t"), "same").when(same("b", "t"), F.when(F.col("h").isNull(), "delete there").otherwise("push")).when(same("b", "h"), F.when(F.col("t").isNull(), "delete here").otherwise("pull")).otherwise("conflict")
    return joined.select("path", state.alias("state"))


def dossiers(subjects: DataFrame, facts: DataFrame, key: str, title: str, line: str, order: str, most: int = 50) -> DataFrame:
    """A Markdown text per subject: its title and its first facts in order; further ones are counted, not listed."""
    ranked = facts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order, line))).withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    listed = ranked.where(F.col("_r") <= most).groupBy(key).agg(F.max("_n").alias("_n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", F.col(line).alias("_line")))), lambda f: F.concat(F.lit("- "), f["_line"])), "\n").alias("_lines"))
    more = F.when(F.col("_n") > most, F.concat(F.lit("\n- and "), (F.col("_n") - most).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return subjects.join(listed, key, "left").select(key, F.concat(F.lit("# "), F.col(title), F.coalesce(F.concat(F.lit("\n\n"), "_lines", more), F.lit(""))).alias("markdown"))


def write_table(df: DataFrame, path: str, order: list[str], form: str = "json") -> None:
    """A deterministic export in total order over many files: names and rows depend on the content alone. ``json`` (lines), ``csv``
    (nested values as JSON) or ``markdown`` (one table row a line)."""
    placed = df.orderBy(*order)
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    if form == "json":
        placed.write.mode("overwrite").json(path)
        return
    flat = placed.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])
    if form == "csv":
        flat.write.mode("overwrite").option("header", True).csv(path)
        return
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    flat.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |")).alias("value")).write.mode("overwrite").text(path)


def write_subset(elements: DataFrame, keep: DataFrame, path: str) -> None:
    """JSON array files with only the kept elements, each with its original bytes: (path, position) of ``keep`` picks them. Every file
    is written as lines of its own folder ``file=...``; the elements stay in order."""
    kept = elements.join(keep.select("path", "position").distinct(), ["path", "position"], "left_semi")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kept.select(name.alias("file"), "position", F.col("body").alias("value")).repartition("file").sortWithinPartitions("file", "position").select("file", "value").write.mode("overwrite").partitionBy("file").text(path)


def as_pandas_reader(parse: Callable[[str, bytes], Iterator[dict]], schema: str) -> Callable[[DataFrame], DataFrame]:
    """A reader of files from a function that yields rows; its failures become rows with an error."""
    return lambda df: readers._per_file(df, parse, schema)


def put_blobs(rows: DataFrame, content: str) -> DataFrame:
    """A store by content: digest, bytes and content, each content once."""
    keyed = rows.where(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("digest"), F.octet_length(content).alias("bytes"), F.col(content).alias("content"))
    return keyed.dropDuplicates(["digest"])


def get_blobs(references: DataFrame, store: DataFrame, digest: str = "digest") -> DataFrame:
    """References with their contents; a content that isn't what its digest says is an error, a missing one null."""
    joined = references.join(store.select(F.col("digest").alias(digest), "content"), digest, "left")
    good = F.col("content").isNull() | (F.sha2("content", 256) == F.col(digest))
    return joined.withColumn("content", F.when(good, F.col("content")).otherwise(F.raise_error(F.lit("a blob has changed"))))
