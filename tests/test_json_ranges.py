"""The split scan of JSON arrays against a sequential scan, at splits of some bytes; copies of subsets."""

import json
import random

import pytest

from tidewater.sources import json_ranges as J


def scan(raw, level=1, start=None):
    """Spans by one pass over the bytes."""
    at = raw.index(b"[") if start is None else start
    depth, quoted, escaped, begin, out = level - 1, False, False, at + 1, []

    def put(a, b):
        body = raw[a:b]
        left = len(body) - len(body.lstrip(b" \t\r\n"))
        body = body.strip(b" \t\r\n")
        if body:
            out.append((len(out), a + left, a + left + len(body), body.decode()))

    for k in range(at, len(raw)):
        c = raw[k : k + 1]
        if quoted:
            if escaped:
                escaped = False
            elif c == b"\\":
                escaped = True
            elif c == b'"':
                quoted = False
        elif c == b'"':
            quoted = True
        elif c in b"[{":
            depth += 1
        elif c in b"]}":
            depth -= 1
            if depth == level - 1:
                put(begin, k)
                return out
        elif c == b"," and depth == level:
            put(begin, k)
            begin = k + 1
    raise ValueError


def value(rng, deep=0):
    kind = rng.randint(0, 7 if deep < 4 else 4)
    if kind < 2:
        return rng.choice([None, True, -1.5, 12345678901, 0])
    if kind < 5:
        return "".join(rng.choice(["a", ",", "[", "]", "{", "}", '"', "\\", "\\\\", "é", "漢", " ", "\n", ":", '",', '\\"', "]]"]) for _ in range(rng.randint(0, 12)))
    if kind == 5:
        return {f"k{j},": value(rng, deep + 1) for j in range(rng.randint(0, 4))}
    return [value(rng, deep + 1) for _ in range(rng.randint(0, 5))]


@pytest.fixture
def split(spark):
    """Splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(n):
        spark.conf.set(names[0], n)
        spark.conf.set(names[1], 1)

    yield to
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def got(spark, path, wrapper=None):
    rows = J.array_elements(spark, str(path), wrapper).orderBy("path", "position").collect()
    assert not [r for r in rows if r.error], rows[0].error
    return [(r.position, r.begin, r.end, r.body) for r in rows]


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_spans_equal_the_sequential_scan(spark, split, tmp_path, size):
    split(size)
    rng = random.Random(size)
    for k in range(2):
        text = json.dumps([value(rng) for _ in range(150)], ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([(",", ":"), (" ,\n ", " : ")]))
        raw = (b"\xef\xbb\xbf" if k else b"") + (" \n" * k + text + "\n" * k).encode()
        path = tmp_path / f"a{k}.json"
        path.write_bytes(raw)
        if size < 400:
            assert J.lines(spark, str(path)).select("start").distinct().count() > 8
        want = scan(raw)
        assert got(spark, path) == want and all(raw[a:b].decode() == body for _, a, b, body in want)


def test_wrapped_array(spark, split, tmp_path):
    split(50)
    rng = random.Random(4)
    items = [value(rng) for _ in range(60)]
    head = json.dumps({"meta": {"items": [1, 2, [3]]}, 'x"items': 'or "items": [', "other": [[1, 2], {"items": [5]}]})[:-1]
    raw = (head + ', "items" : ' + json.dumps(items) + ', "tail": [1, [2, 3], {"items": [7, 8]}]}').encode()
    path = tmp_path / "w.json"
    path.write_bytes(raw)
    want = scan(raw, 2, raw.index(b'"items" : [') + 10)
    assert [json.loads(x[3]) for x in want] == items
    assert got(spark, path, "items") == want


def test_many_files_and_errors(spark, split, tmp_path):
    split(30)
    files = {"a": b"[]", "b": b" [ ]", "c": b'["x"]', "d": b"[1, 2", "e": b'{"a": [1]}', "f": b'[1,\t{"a": "]"} , [2,3]] , [9]', "g": b'["' + b"long " * 100 + b'", "' + b",," * 50 + b'"]'}
    for name, raw in files.items():
        (tmp_path / f"{name}.json").write_bytes(raw)
    rows = J.array_elements(spark, str(tmp_path)).collect()
    of = lambda name: [r for r in sorted(rows, key=lambda r: r.position or 0) if r.path.endswith(f"/{name}.json")]
    assert of("a") == of("b") == [] and [r.body for r in of("c")] == ['"x"']
    assert [r.error for r in of("d")] == ["the array doesn't end"] and [r.error for r in of("e")] == ["the top level is not an array"]
    assert [r.body for r in of("f")] == ["1", '{"a": "]"}', "[2,3]"] and [(r.position, r.begin, r.end, r.body) for r in of("g")] == scan(files["g"])
    assert {r.error for r in J.array_elements(spark, str(tmp_path / "c.json"), "k").collect()} == {"no array of that name"}


def test_subset_keeps_bytes(spark, split, tmp_path):
    split(64)
    rng = random.Random(7)
    raw = json.dumps([value(rng) for _ in range(80)], separators=(", ", ":  ")).encode()
    path = tmp_path / "in.json"
    path.write_bytes(raw)
    elements = J.array_elements(spark, str(path))
    J.keep_elements(elements, elements.where("position % 3 = 1"), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    want = [x[3] for x in scan(raw) if x[0] % 3 == 1]
    assert [x[3] for x in scan(text)] == want and json.loads(text) == [json.loads(x) for x in want]
    J.keep_elements(elements, elements.where("false"), str(tmp_path / "none"))
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "none").glob("part-*"))).strip() == b"[]"
