"""Readers on small files, and streams against their batch results."""

import io
import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.sources import readers as R
from tidewater.streaming import incremental as I

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def folder(tmp_path):
    tree = {"title": "t", "current_node": "c", "mapping": {
        "a": {"parent": None, "children": ["b", "x"], "message": {"author": {"role": "user"}, "content": {"parts": ["hi"]}}},
        "b": {"parent": "a", "children": ["c"], "message": None},
        "x": {"parent": "a", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["other"]}}},
        "c": {"parent": "b", "children": [], "message": {"author": {"role": "assistant"}, "content": {"parts": ["hello", "you"]}}}}}
    (tmp_path / "tree.json").write_text(json.dumps([tree, {"name": "n", "chat_messages": [{"sender": "human", "text": "q]\"["}]}]))
    (tmp_path / "bad.json").write_text("{")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/one.txt", "1")
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../evil", "no")
    con = sqlite3.connect(tmp_path / "chat.db")
    con.execute("CREATE TABLE messages (conv_id TEXT, role TEXT, content TEXT)")
    con.executemany("INSERT INTO messages VALUES (?, ?, ?)", [("k", "user", "a"), ("k", "assistant", "b")])
    con.commit()
    con.close()
    (tmp_path / "page.html").write_text('<html><style>p{}</style><div class="msg user">Hi <b>there</b></div><div data-role="assistant">Yo</div></html>')
    (tmp_path / "m.mht").write_text("MIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: base64\n\nPGI+aGk8L2I+\n--B--\n")
    return tmp_path


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_readers(spark, folder):
    f = lambda p: R.files(spark, str(folder), p)
    assert rows(R.json_messages(f("tree.json")), "conversation", "role", "text") == [("n", "human", 'q]"['), ("t", "assistant", "hello\nyou"), ("t", "user", "hi")]
    assert R.json_messages(f("bad.json")).first()["error"].startswith("JSONDecodeError")
    assert rows(R.zip_members(f("*.zip")), "member", "bytes") == [("in.zip!deep.txt", 4), ("x/one.txt", 1)]
    assert rows(R.sqlite_messages(f("*.db")), "conversation", "role", "text") == [("k", "assistant", "b"), ("k", "user", "a")]
    assert rows(R.html_messages(f("*.html")), "position", "role", "text") == [(0, "user", "Hi there"), (1, "assistant", "Yo")]
    assert rows(R.mht_parts(f("*.mht")), "role", "text") == [("text/html", "<b>hi</b>")]
    spans = R.json_array_elements(f("tree.json")).orderBy("position").collect()
    body = (folder / "tree.json").read_bytes()
    assert [json.loads(body[s.begin : s.end]) for s in spans] == json.loads(body)
    formats = f("*").select(R.detect_format(F.col("path"), F.col("content")).alias("f"))
    assert rows(formats, "f") == [("html",), ("json",), ("json",), ("mht",), ("sqlite",), ("zip",)]


def test_jsonl_keeps_corrupt_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"role":"user","content":"a"}\nnot json\n')
    got = R.jsonl(spark, str(tmp_path / "x.jsonl"), "role string, content string").cache()
    assert got.count() == 2 and got.where("_corrupt is not null").count() == 1
    R.write_export(got.select("role", "content"), str(tmp_path / "out"), ["role"])
    assert spark.read.json(str(tmp_path / "out")).count() == 2


@pytest.fixture()
def feed(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("event_id")
    for k in range(3):
        events.where(f"event_id >= {k * 334} and event_id < {(k + 1) * 334}").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    return str(tmp_path / "feed")


def test_streams_equal_batches(spark, feed):
    batch = spark.read.parquet(feed).withColumn("ts", F.col("ts").cast("timestamp"))
    live = I.drain(I.windowed(I.event_stream(spark, feed), "6 hours", late="90 days"), "live_windows", "complete")
    assert set(map(tuple, live.collect())) == set(map(tuple, I.windowed(batch, "6 hours").collect()))
    unique = I.drain(I.deduplicated(I.event_stream(spark, feed), ["event_id"]), "live_unique")
    assert unique.count() == batch.count()
    views, buys = (I.event_stream(spark, feed).where(F.col("event_type") == k) for k in ("view", "purchase"))
    pairs = I.drain(I.interval_join(views, buys, "user_id", "2 hours", late="90 days"), "live_pairs")
    v, b = batch.where("event_type = 'view'"), batch.where("event_type = 'purchase'")
    want = I.interval_join(v, b, "user_id", "2 hours")
    assert set(map(tuple, pairs.collect())) == set(map(tuple, want.collect()))


def test_queue_and_index(spark, feed, tmp_path):
    states = I.drain(I.queue_states(I.event_stream(spark, feed)), "live_queue", "update")
    seen = dict(states.groupBy("user_id").agg(F.max("seen")).collect())
    want = dict(spark.read.parquet(feed).groupBy("user_id").agg(F.count("*")).collect())
    assert seen == want
    index = I.IncrementalIndex(spark, str(tmp_path / "index"))
    index.apply(spark.createDataFrame([(1, "red red blue"), (2, "blue")], "doc_id long, text string"), 0)
    index.apply(spark.createDataFrame([(1, "green")], "doc_id long, text string"), 1)
    assert rows(index.current(), "doc_id", "term", "tf") == [(1, "green", 1), (2, "blue", 1)]
