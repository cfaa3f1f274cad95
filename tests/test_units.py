"""Unit readers, scans, writers and logs on small files and tables."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.sources import readers as R
from tidewater.sources import units as U
from tidewater.streaming import upkeep as M


@pytest.fixture()
def folder(tmp_path):
    tree = [{"title": "t", "current_node": "b", "mapping": {
        "a": {"parent": None, "message": {"author": {"role": "user"}, "content": {"parts": ["question"]}, "weight": 1}},
        "b": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["one"]}}},
        "c": {"parent": "a", "message": {"author": {"role": "assistant"}, "content": {"parts": ["other"]}}}}}]
    (tmp_path / "tree.json").write_text(json.dumps(tree))
    (tmp_path / "linear.json").write_text(json.dumps([{"uuid": "u", "name": "n", "chat_messages": [{"uuid": "1", "sender": "human", "text": "hello", "attachments": [{"file_name": "a.pdf"}]}, {"uuid": "2", "sender": "assistant", "text": "yes"}]}]))
    (tmp_path / "session.jsonl").write_text("\n".join(json.dumps({"sessionId": "s", "uuid": str(k), "parentUuid": str(k - 1) if k else None, "type": "user", "message": {"role": "user", "content": [{"type": "text", "text": f"line {k}"}]}}) for k in range(2)))
    (tmp_path / "wrapped.js").write_text('window.data = [{"header": "App", "title": "Asked a thing", "time": "2024-01-01T00:00:00Z"}];')
    (tmp_path / "broken.json").write_text('{"a": ')
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.json").write_text("[]")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.json", json.dumps([{"role": "user", "content": "within"}]))
    with zipfile.ZipFile(tmp_path / "pack.zip", "w") as z:
        z.writestr("chat.json", json.dumps([{"role": "user", "content": "zipped"}]))
        z.writestr("in.zip", inner.getvalue())
        z.writestr("../evil.json", "[]")
        z.writestr("notes.bin", "text")
    return tmp_path


def test_full_messages(spark, folder):
    rows = U.full_messages(R.files(spark, str(folder), "*.js*")).collect()
    by = {(r.conversation, r.id): r for r in rows if r.error is None}
    assert {k: (v.parent, v.role, v.text) for k, v in by.items()} == {
        ("t", "a"): (None, "user", "question"), ("t", "b"): ("a", "assistant", "one"), ("t", "c"): ("a", "assistant", "other"),
        ("n", "1"): (None, "human", "hello"), ("n", "2"): ("1", "assistant", "yes"),
        ("s", "0"): (None, "user", "line 0"), ("s", "1"): ("0", "user", "line 1"), ("App", "2024-01-01T00:00:00Z"): (None, "user", "Asked a thing"),
    }
    assert by["n", "1"].attachments == ["a.pdf"] and json.loads(by["t", "a"].unknown) == {"weight": 1}
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["broken.json"]


def test_containers_and_zip_messages(spark, folder):
    zips = R.files(spark, str(folder), "*.zip")
    found = {(r.container, r.member.rsplit("/", 1)[-1]): r.kind for r in U.containers(zips).collect()}
    assert found[(next(c for c, m in found if m == "in.zip")), "in.zip"] == "zip"
    assert {m for _, m in found} == {"pack.zip", "chat.json", "in.zip", "deep.json", "notes.bin"}
    rows = U.zip_messages(zips).collect()
    assert {r.text for r in rows if r.text} == {"zipped", "within"} and [r.error for r in rows if r.error] == ["no reader for text"]


def test_walk_and_platforms(spark, folder):
    names = [r.path.rsplit("/", 1)[1] for r in U.walk(spark, str(folder)).collect()]
    assert names == ["broken.json", "linear.json", "session.jsonl", "tree.json", "wrapped.js"]
    shapes = ['{"mapping": {}, "title": "x"}', '{"chat_messages": [], "uuid": 1}', '{"role": "user", "text": "x"}', '{"other": 1}', "no json"]
    got = spark.createDataFrame(list(enumerate(shapes)), "k int, e string").select("k", U.platform(F.col("e")).alias("p")).orderBy("k").collect()
    assert [r.p for r in got] == ["tree", "linear", "messages", None, None]


def test_strict_documents(spark, tmp_path):
    files = {"a.json": '{"b": 1, "a": [true]}', "twice.json": '{"a": 1, "a": 2}', "nan.json": "[NaN]", "deep.json": "[" * 99 + "]" * 99, "x.xml": "<r k='v'>t<c/></r>", "evil.xml": "<!DOCTYPE x><r/>", "t.csv": "p,q\n1,2\n", "bad.csv": "p,p\n1,2\n"}
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    rows = {r.path.rsplit("/", 1)[1]: r for r in U.strict_documents(R.files(spark, str(tmp_path))).collect()}
    assert rows["a.json"].canonical == '{"a":[true],"b":1}' and rows["t.csv"].canonical == '[{"p":"1","q":"2"}]'
    assert json.loads(rows["x.xml"].canonical) == {"tag": "r", "attributes": {"k": "v"}, "text": "t", "children": [{"tag": "c", "attributes": {}, "text": "", "children": []}]}
    assert all(rows[n].error for n in ("twice.json", "nan.json", "deep.json", "evil.xml", "bad.csv"))


def test_line_pointers_and_subset(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps({"a": {"b/c": k}, "l": [k, k + 1]}) for k in range(50)))
    rows = U.lines(spark, str(tmp_path / "x.jsonl"))
    assert [r.line for r in rows.orderBy("line").collect()] == list(range(50))
    assert U.at_pointer(rows, "/7/l/1").first().value == "8"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('[{"x":  1}, [2 ,3], "four"]')
    elements = R.json_array_elements(R.files(spark, str(tmp_path / "in")))
    U.write_subset(elements, elements.where("position <> 1"), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['"four"', '{"x":  1}']


@pytest.mark.parametrize("form", ["json", "csv", "markdown"])
def test_exports_depend_on_content_alone(spark, tmp_path, form):
    df = spark.createDataFrame([(2, ["a", "b"], "x|y"), (1, [], None)], "k int, l array<string>, t string")
    for n, part in enumerate((df.repartition(3), df)):
        U.write_table(part, str(tmp_path / str(n)), ["k"], form)
    one, two = (sorted(r.value for r in spark.read.text(str(tmp_path / str(n))).collect()) for n in (0, 1))
    assert one == two and len(one) >= 2


def test_bus_log_and_progress(spark, tmp_path):
    log = M.appended(spark.createDataFrame([(5, "a")], "seq long, key string"), spark.createDataFrame([("c",), ("a",), ("b",)], "key string"), "key", "key")
    assert [tuple(r) for r in log.orderBy("seq").collect()] == [(6, "b"), (7, "c")]
    spark.range(6).select(F.col("id"), F.when(F.col("id") % 2 == 0, "x:even").otherwise("y:odd").alias("type")).coalesce(1).write.parquet(str(tmp_path / "in"))
    got, seen = [], []
    bus = M.Bus(lambda df, n: got.append(("log", df.count())))
    bus.subscribe("x:*", lambda df, n: got.append(("even", df.count())))
    listener = M.Progress(spark, lambda q, n, rows: seen.append(rows))
    spark.streams.addListener(listener)
    bus.start(spark.readStream.schema("id long, type string").parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    spark.streams.removeListener(listener)
    assert got == [("log", 6), ("even", 3)]


def test_catalogue_scan_refuses_nothing(spark):
    units = spark.createDataFrame([("p", "1", 10, "x"), ("p", "1", 12, "y"), ("q", "1", 11, "x"), ("p", "2", 13, "z")], "platform string, ext_id string, created long, digest string")
    known = spark.createDataFrame([("p", "2", 1, "old")], units.schema)
    got = {(r.platform, r.ext_id, r.digest): (r.state, r.previous, r.version_num) for r in U.scan(units, known).collect()}
    assert got == {("p", "1", "x"): ("new", None, 1), ("p", "1", "y"): ("version", "x", 2), ("q", "1", "x"): ("duplicate", None, None), ("p", "2", "z"): ("version", "old", 2)}
