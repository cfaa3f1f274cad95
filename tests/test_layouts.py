"""Layout fingerprints: paths, parts that add up in any order, and recognition against a plain version."""

import json
import math
import random

from tidewater.operators import layouts as L

LAYOUTS = {
    "tree": [L.Descriptor("/mapping", 0.95), L.Descriptor("/title", 0.7, optional=True), L.Descriptor("/messages", 0.9, absent=True)],
    "flat": [L.Descriptor("/messages", 0.9), L.Descriptor("/messages/*/role", 0.9), L.Descriptor("/uuid", 0.8, optional=True)],
}


def corpora(seed=3):
    rng = random.Random(seed)
    out = []
    for k in range(60):
        kind = ["t", "f", "x"][k % 3]
        body = {"t": {"mapping": {"a": {"b": None}}, "title": "x"}, "f": {"messages": [{"role": "u", "n": 1}, {"role": "v", "t~/": "y"}]}, "x": {"rows": [1, [2, {"deep": {"er": 1}}]]}}[kind]
        if rng.random() < 0.3:
            body = {**body, "uuid": 5, "title": None}
        out.append((k, kind, json.dumps(body) if k % 13 else "not json"))
    return [*out, (100, "e", None)]


def frames(spark, rows):
    df = spark.createDataFrame(rows, "id long, corpus string, body string")
    return L.key_paths(df, "id", "body"), df.select("id", "corpus")


def test_paths(spark):
    rows = [(1, '{"a": [{"b/c": 1}, {"b/c": "x"}], "d": {"e": {"f": {"g": true}}}}'), (2, "[]"), (3, "{"), (4, None), (5, "3")]
    got = {}
    for r in L.key_paths(spark.createDataFrame(rows, "id long, body string"), "id", "body", 3).collect():
        got.setdefault(r.id, set()).add((r.path, r.kind))
    assert got == {
        1: {("/", "object"), ("/a", "array"), ("/a/*", "object"), ("/a/*/b~1c", "number"), ("/a/*/b~1c", "string"), ("/d", "object"), ("/d/e", "object"), ("/d/e/f", "object")},
        2: {("/", "array")}, 3: {("!", "none")}, 5: {("/", "number")},
    }


def test_parts_add_up_in_any_order(spark):
    rows = corpora()
    whole = {tuple(r) for r in L.fingerprint(*frames(spark, rows)).collect()}
    a, b, c = (L.fingerprint(*frames(spark, rows[k::3])) for k in range(3))
    for out in (L.merged(a, b, c), L.merged(L.merged(c, a), b), L.merged(b, L.merged(a, c))):
        assert {tuple(r) for r in out.collect()} == whole


def test_recognition(spark):
    rows = corpora()
    got = {(r.corpus, r.layout): r for r in L.recognised(L.fingerprint(*frames(spark, rows)), LAYOUTS).collect()}
    share = {}
    for corpus in "tfxe":
        units = [b for _, c, b in rows if c == corpus]
        seen = []
        for b in units:
            found = set()
            if b is not None:
                try:
                    L._paths(json.loads(b), "", 4, found)
                except ValueError:
                    found = {("!", "none")}
            seen.append({p for p, _ in found})
        share[corpus] = {p: sum(p in s for s in seen) / len(units) for p in set().union(*seen)}
    for corpus in "tfxe":
        weights = {"unknown": math.exp(2.0)}
        for name, ds in LAYOUTS.items():
            holds = [(share[corpus].get(d.path, 0) >= 0.5) != d.absent for d in ds]
            out = any(not h and not d.optional for h, d in zip(holds, ds, strict=True))
            gain = sum(math.log(d.reliability / (1 - d.reliability)) for h, d in zip(holds, ds, strict=True) if h)
            row = got[corpus, name]
            assert row.excluded == out and math.isclose(row.evidence, gain, abs_tol=1e-5)
            if not out:
                weights[name] = math.exp(gain)
            own = [d.path for d in ds if not d.absent]
            both = sum(share[corpus].get(p, 0) for p in own)
            assert math.isclose(row.overlap, both / (len(own) + sum(share[corpus].values()) - both), abs_tol=1e-5)
        for name in (*LAYOUTS, "unknown"):
            assert math.isclose(got[corpus, name].share, weights.get(name, 0) / sum(weights.values()), abs_tol=1e-5)
    assert got["t", "tree"].confident and got["f", "flat"].confident and not any(got["x", n].confident for n in LAYOUTS)
