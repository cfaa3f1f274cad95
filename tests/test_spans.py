"""Claims in conflict against a plain log, text levels and interval sweeps against plain versions."""

import hashlib
import random
import re

import pytest

from tidewater.operators import spans as S


def plain_log(claims, texts):
    have, out = [], {}
    for c in sorted(claims, key=lambda c: (c["seq"], c["id"])):
        mine = [h for h in have if (h["text_id"], h["category"]) == (c["text_id"], c["category"])]
        if c["retracts"] is not None:
            hit = [h for h in mine if h["id"] == c["retracts"] and h["state"] == "active"]
            for h in hit:
                h["state"] = "retracted"
            out[c["id"]] = ("retracted" if hit else "invalid", None, [c["retracts"]])
            continue
        n = len(texts.get(c["text_id"], ""))
        start, end = max(0, c["start"]), n if c["end"] is None else min(c["end"], n)
        if end <= start:
            out[c["id"]] = ("invalid", None, [])
            continue
        same = [h for h in mine if (h["producer"], h["version"], h["s"], h["e"]) == (c["producer"], c["version"], start, end) and h["state"] != "superseded"]
        if same:
            out[c["id"]] = ("duplicate" if same[0]["state"] == "active" else "suppressed", same[0]["id"], [])
            continue
        rivals = sorted((h for h in mine if h["state"] == "active" and h["s"] < end and start < h["e"]), key=lambda h: h["s"])
        user = c["origin"] == "user"
        above = [h for h in rivals if (h["origin"] == "user") > user or ((h["origin"] == "user") == user and h["confidence"] > c["confidence"] + 1e-9)]
        new = {**c, "s": start, "e": end, "state": "superseded" if above else "active"}
        have.append(new)
        if above:
            out[c["id"]] = ("lost", max(above, key=lambda h: h["confidence"])["id"], [])
        else:
            for h in rivals:
                h["state"] = "superseded"
            out[c["id"]] = ("replaced" if rivals else "created", None, [h["id"] for h in rivals])
    return out, {h["id"] for h in have if h["state"] == "active"}


def test_claim_log(spark):
    rng = random.Random(3)
    texts = {k: "x" * rng.randint(5, 30) for k in range(6)}
    claims = []
    for k in range(700):
        back = k > 20 and rng.random() < 0.08
        t, cat = rng.randint(0, 6), rng.choice(["noise", "note"])
        if back:
            old = rng.choice(claims)
            t, cat = old["text_id"], old["category"]
        claims.append({"id": k, "text_id": t, "category": cat, "seq": k // 2, "start": rng.choice([-2, *range(0, 28)]) if not back else None, "end": rng.choice([None, *range(0, 33)]) if not back else None,
                       "producer": rng.choice("pq"), "version": rng.choice("12"), "origin": rng.choice(["user", "model", "model", None]), "confidence": rng.choice([0.3, 0.5, 0.9]), "retracts": old["id"] if back else None})
        if not back and k > 50 and rng.random() < 0.2:
            claims[-1] |= {c: v for c, v in rng.choice([c for c in claims[:-1] if c["retracts"] is None]).items() if c not in ("id", "seq", "origin", "confidence")}
    schema = "id long, text_id long, category string, seq long, start long, end long, producer string, version string, origin string, confidence double, retracts long"
    frame = spark.createDataFrame([tuple(c.values()) for c in claims], schema).repartition(3)
    log = S.claim_log(frame, spark.createDataFrame(list(texts.items()), "id long, text string"))
    want, active = plain_log(claims, texts)
    assert {r.id: (r.outcome, r.by, r.replaced) for r in log.collect()} == want
    assert {x[0] for x in want.values()} == set(S.OUTCOMES)
    assert {r.id for r in S.in_force(log).collect()} == active


LEVELS = {"light": (["filler"], None), "clean": (["thanks", "signal_like"], "light"), "core": (["aside"], "clean")}
CLASSES = {"filler": "droppable", "thanks": "droppable", "aside": "droppable", "decision": "signal"}


def plain_level(text, spans, level):
    cats, at = set(), level
    while at:
        cats |= set(LEVELS[at][0])
        at = LEVELS[at][1]
    signals = [s for s in spans if CLASSES.get(s[0]) == "signal" and s[3] >= 0.5 and not (s[1] <= 0 and s[2] >= len(text))]
    gone, n = set(), 0
    for cat, a, b, conf in spans:
        if cat not in cats or conf < 0.5 or (CLASSES.get(cat) == "droppable" and any(a < s[2] and s[1] < b for s in signals)):
            continue
        n += 1
        gone |= set(range(a, b))
    out = "".join(c for k, c in enumerate(text) if k not in gone)
    out = re.sub(r" ([,.;:!?])", r"\1", re.sub(r"[ \t]+", " ", out))
    out = re.sub(r",{2,}", ",", out).lstrip(" ,;\n").rstrip(" ,")
    usable = bool(n) and out not in ("", text)
    return (out if usable else text, usable, n)


def test_text_levels(spark):
    rng = random.Random(7)
    texts, rows, want = [], [], {}
    for k in range(60):
        text = "".join(rng.choice(["well", ", ", " thanks", ". ", "é", "  ", "yes", "漢", ",", "\n", " so"]) for _ in range(rng.randint(1, 14)))
        texts.append((k, text))
        spans = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, len(text) - 1)
            spans.append((rng.choice(["filler", "thanks", "aside", "decision", "signal_like", "other"]), a, rng.randint(a + 1, len(text)), rng.choice([0.3, 0.5, 0.9])))
        if k % 9 == 0:
            spans.append(("decision", 0, len(text), 0.9))
        rows += [(k, *s, hashlib.sha256(text.encode()).hexdigest()) for s in spans]
        stale = [(k, "filler", 0, 1, 0.9, "old")] if k % 5 == 0 else []
        rows += stale
        for level in LEVELS:
            got = plain_level(text, spans, level)
            if got[2]:
                want[k, level] = (*got, len(stale))
    frame = spark.createDataFrame(rows, "text_id long, category string, start long, end long, confidence double, source_hash string")
    got = {(r.id, r.level): (r.text, r.usable, r.dropped, r.stale) for r in S.text_levels(spark.createDataFrame([*texts, (99, None)], "id long, text string"), frame, LEVELS, CLASSES).collect()}
    assert {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v} == {} and got.keys() == want.keys()
    assert {x[1] for x in want.values()} == {True, False}


def test_circles_are_refused():
    with pytest.raises(ValueError):
        S.closed_categories({"a": (["x"], "b"), "b": ([], "a")})
    assert S.closed_categories(LEVELS)["core"] == ["aside", "filler", "signal_like", "thanks"]


def test_unions(spark):
    rows = [(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 2)]
    assert {tuple(r) for r in S.unions(spark.createDataFrame(rows, "k long, start long, end long"), ["k"]).collect()} == {(1, 0, 5), (1, 7, 9), (2, 1, 2)}
