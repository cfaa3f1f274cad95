"""Readers of archives and export formats into message and unit DataFrames.

Files come through Spark's ``binaryFile`` or ``text`` sources, so any Hadoop path works and each file is one task's work;
what no built-in source parses is parsed in ``mapInPandas``. An unreadable input is a row with an error, never a lost one.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGES = "path string, conversation string, position long, role string, text string, error string"
MEMBERS = "path string, member string, bytes long, content binary, error string"
ELEMENTS = "path string, position long, begin long, end long, body string, error string"
#: File name endings and the formats they stand for.
ENDINGS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "zip": "zip", "html": "html", "htm": "html", "mht": "mht", "mhtml": "mht", "md": "markdown", "txt": "text", "db": "sqlite", "sqlite": "sqlite"}


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a path: path, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def detect_format(path: Column, content: Column) -> Column:
    """By the name's ending, else by the first 200 bytes."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in ENDINGS.items() for x in kv]), ending)
    head = F.trim(F.decode(F.substring(content, 1, 200), "ISO-8859-1"))
    sniffed = (
        F.when(head.startswith("PK\x03\x04"), "zip").when(head.startswith("SQLite format 3"), "sqlite").when(head.rlike("(?i)^mime-version|^content-type: multipart"), "mht")
        .when(head.rlike(r"(?i)^(<!doctype html|<html)"), "html").when(head.rlike(r"^\{.*\}\s*\n\{"), "jsonl").when(head.rlike(r"^[\[{]"), "json").otherwise("text")
    )
    return F.coalesce(known, sniffed)


def _per_file(df: DataFrame, parse, schema: str) -> DataFrame:
    """Run ``parse(path, content)`` on each file; its error becomes a row."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows = [dict(r, path=path) for r in parse(path, bytes(content))]
                except Exception as problem:  # noqa: BLE001  reported as the file's row
                    rows = [{"path": path, "error": f"{type(problem).__name__}: {problem}"[:500]}]
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    return df.select("path", "content").mapInPandas(run, schema)


def zip_members(df: DataFrame) -> DataFrame:
    """Members of zip archives (and of zips within them), skipping folders and unsafe names."""

    def walk(prefix: str, content: bytes, depth: int):
        import zipfile

        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                name = info.filename
                if info.is_dir() or name.startswith(("/", "__MACOSX")) or ".." in name.split("/"):
                    continue
                body = archive.read(info)
                if depth and body[:4] == b"PK\x03\x04":
                    yield from walk(f"{prefix}{name}!", body, depth - 1)
                else:
                    yield {"member": prefix + name, "bytes": len(body), "content": body}

    return _per_file(df, lambda path, content: walk("", content, 3), MEMBERS)


def sqlite_messages(df: DataFrame) -> DataFrame:
    """Tables of SQLite files that have a role and a content or text column."""

    def parse(path: str, content: bytes):
        import sqlite3

        con = sqlite3.connect(":memory:")
        con.deserialize(content)
        for (table,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
            columns = [r[1] for r in con.execute(f'PRAGMA table_info("{table}")')]
            text = next((c for c in ("content", "text") if c in columns), None)
            if "role" in columns and text:
                group = next((c for c in ("conversation_id", "conv_id") if c in columns), None)
                query = f'SELECT role, "{text}", {group or "NULL"} FROM "{table}" ORDER BY rowid'
                for k, (role, body, conversation) in enumerate(con.execute(query)):
                    yield {"conversation": str(conversation) if group else table, "position": k, "role": role, "text": body}

    return _per_file(df, parse, MESSAGES)


def json_messages(df: DataFrame) -> DataFrame:
    """Chat exports in JSON: message trees (the path to the current node), sender lists, and role/content lists."""

    def conversation(name: str, value):
        if isinstance(value, dict) and isinstance(value.get("mapping"), dict):
            nodes, at, path = value["mapping"], value.get("current_node"), []
            if at not in nodes:
                at = next((k for k in reversed(nodes) if not nodes[k].get("children")), None)
            seen = set()
            while at in nodes and at not in seen:
                seen.add(at)
                path.append(nodes[at].get("message"))
                at = nodes[at].get("parent")
            messages = [(m["author"]["role"], "\n".join(p for p in m["content"].get("parts", []) if isinstance(p, str))) for m in reversed(path) if m]
        else:
            items = value if isinstance(value, list) else value.get("chat_messages") or value.get("messages") or [value]
            messages = [(m.get("sender") or m.get("role"), m.get("text") or m.get("content")) for m in items if isinstance(m, dict)]
        for k, (role, text) in enumerate(messages):
            if text:
                yield {"conversation": name, "position": k, "role": role, "text": text if isinstance(text, str) else str(text)}

    def parse(path: str, content: bytes):
        import json

        data = json.loads(content)
        many = isinstance(data, list) and data and isinstance(data[0], dict) and ("mapping" in data[0] or "chat_messages" in data[0] or "messages" in data[0])
        for k, value in enumerate(data if many else [data]):
            title = value.get("title") or value.get("name") or value.get("uuid") if isinstance(value, dict) else None
            yield from conversation(str(title or k), value)

    return _per_file(df, parse, MESSAGES)


def json_array_elements(df: DataFrame) -> DataFrame:
    """Elements of a top-level JSON array with their byte offsets; one pass, no parsing of the elements."""

    def parse(path: str, content: bytes):
        depth, begin, quoted, escaped, count = 0, None, False, False, 0
        for k, byte in enumerate(content):
            if quoted:
                escaped, quoted = (not escaped and byte == 92), not (byte == 34 and not escaped)
                continue
            if byte == 34:
                quoted = True
            if byte in b"[{":
                depth += 1
            if depth == 1 and byte in b",]":
                if begin is not None:
                    body = content[begin:k].rstrip()
                    yield {"position": count, "begin": begin, "end": begin + len(body), "body": body.decode()}
                    begin, count = None, count + 1
            elif depth >= 1 and begin is None and byte not in b" \t\r\n" and not (depth == 1 and byte == 91 and count == 0 and k == content.find(b"[")):
                begin = k
            if byte in b"]}":
                depth -= 1
        if depth:
            raise ValueError("the array doesn't end")

    return _per_file(df, parse, ELEMENTS)


def html_messages(df: DataFrame) -> DataFrame:
    """HTML chats: elements with a role in class or data-role; else the whole text as one message."""

    def parse(path: str, content: bytes):
        from html.parser import HTMLParser

        class Chat(HTMLParser):
            def __init__(self):
                super().__init__()
                self.stack, self.messages, self.whole, self.hidden = [], [], [], 0

            def handle_starttag(self, tag, attrs):
                if tag in ("br", "img", "hr", "meta", "link", "input"):
                    return
                named = dict(attrs)
                label = f"{named.get('data-role') or ''} {named.get('class') or ''}".lower().split()
                role = next((r for r in ("user", "assistant", "system") if r in label), None)
                if role:
                    self.messages.append([role, []])
                self.hidden += tag in ("script", "style")
                self.stack.append((tag, bool(role)))

            def handle_endtag(self, tag):
                while self.stack:
                    last, _ = self.stack.pop()
                    self.hidden -= last in ("script", "style")
                    if last == tag:
                        break

            def handle_data(self, data):
                if not self.hidden and data.strip():
                    self.whole.append(data.strip())
                    if any(r for _, r in self.stack) and self.messages:
                        self.messages[-1][1].append(data.strip())

        chat = Chat()
        chat.feed(content.decode("utf-8", "replace"))
        for k, (role, parts) in enumerate(chat.messages or [["unknown", chat.whole]]):
            yield {"conversation": path, "position": k, "role": role, "text": " ".join(parts)}

    return _per_file(df, parse, MESSAGES)


def mht_parts(df: DataFrame) -> DataFrame:
    """Text parts of MHT (multipart) files."""

    def parse(path: str, content: bytes):
        import email

        for k, part in enumerate(p for p in email.message_from_bytes(content).walk() if p.get_content_maintype() == "text"):
            body = part.get_payload(decode=True).decode(part.get_content_charset() or "utf-8", "replace")
            yield {"conversation": part.get("Content-Location") or path, "position": k, "role": part.get_content_type(), "text": body}

    return _per_file(df, parse, MESSAGES)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines against a declared schema; what doesn't parse is kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def byte_span(content: Column, begin: Column, end: Column, sha256: Column) -> Column:
    """Bytes of a locator, refused if the content has changed."""
    return F.when(F.sha2(content, 256) == sha256, F.substring(content, begin + 1, end - begin)).otherwise(F.raise_error(F.lit("the content has changed")))


def write_export(df: DataFrame, path: str, order: list[str], form: str = "json") -> None:
    """A deterministic export: rows in total order, one file, no clock in the content."""
    out = df.repartitionByRange(1, *order).sortWithinPartitions(*order)
    getattr(out.write.mode("overwrite"), form)(path)
