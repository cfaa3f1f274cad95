"""Line dedup and the URL filter against brute-force versions."""

import random
import re

import pytest

from tidewater.llm import op1_line_dedup as D
from tidewater.llm import op4_url_filter as U

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(docs, least):
    """Every run of lines of at least ``least`` words that occurred earlier, found by trying all runs."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs.items()):
        split = (text or "").split("\n")
        at = [(p, len(WORD.findall(x))) for p, x in enumerate(split) if WORD.search(x)]
        gone = set()
        for i in range(len(at)):
            total = 0
            fresh = []
            for j in range(i, len(at)):
                total += at[j][1]
                if total >= least:
                    run = tuple(split[p] for p, _ in at[i : j + 1])
                    if run in seen:
                        gone |= {p for p, _ in at[i : j + 1]}
                    fresh.append(run)
            seen |= set(fresh)
        for (a, _), (b, _) in zip(at, at[1:], strict=False):  # lines without a word
            if a in gone and b in gone:
                gone |= set(range(a, b))
        out[doc_id] = None if text is None else "\n".join(x for p, x in enumerate(split) if p not in gone)
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    pool = [" ".join(rng.choice(["red", "blue", "Grün", "漢"]) + str(k) for _ in range(rng.choice([1, 2, 3, 7]))) for k in range(14)] + ["", " "]
    out = {k: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for k in range(150)}
    block = "\n".join(pool[:6])
    return out | {500: block, 501: f"x\n{block}\n\ny", 502: f"{pool[1]}\n{block}\n{pool[2]}\nz", 503: None, 504: "", 505: "a b\n" * 30, 506: out[3]}


@pytest.mark.parametrize("least", [1, 6, 50])
def test_line_dedup(spark, docs, least):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = brute_dedup(docs, least)
    rows = D.dedup_lines(df, least).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.text == want[r.doc_id], (least, r.doc_id)


def test_matches_come_from_joined_and_extended_positions(spark, docs, monkeypatch):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    deleted = lambda: {r.doc_id: r.lines_deleted for r in D.dedup_lines(df, 6).collect()}
    whole = deleted()
    with monkeypatch.context() as m:  # extension from first positions alone: nothing too much; lines of a pool of 14 are also shared elsewhere
        m.setattr(D, "beyond", lambda window: window.where("false").select("d", "t", "first", "last"))
        extended = deleted()
    assert all(extended[k] <= whole[k] for k in whole) and 0 < sum(extended.values()) < sum(whole.values())
    monkeypatch.setattr(D, "joined_positions", lambda position: position.where("false"))
    assert not any(deleted().values())


def test_a_hot_line_in_many_contexts_and_a_long_text(spark):
    # the same line is the least of its windows in every text, with other lines around it: most repeats have no copy at the first one
    rng = random.Random(9)
    hot = "all rights reserved"
    texts = {}
    for k in range(400):
        pair = k % 130
        texts[k] = f"left {pair} a\n{hot}\nright {pair} b" if k % 2 else f"own {k} a\n{hot}\nonly {k} b"
    texts[900] = "\n".join(f"line {rng.randrange(3000)} of {k % 7}" for k in range(6000))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want = brute_dedup({k: t for k, t in texts.items() if k < 900}, 9)
    rows = {r.doc_id: r for r in D.dedup_lines(df, 9).collect()}
    assert {k: rows[k].text for k in want} == want
    assert rows[900].lines_total == 6000


def test_line_dedup_odd_rows(spark):
    text = "one two three\nfour five six"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "q\n" + text)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text, r.lines_deleted) for r in D.dedup_lines(df, 4).collect()), key=str)
    assert got == [(0, text, 0), (1, "", 2), (1, "", 2), (2, "q", 2)]
    assert D.dedup_lines(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        D.dedup_lines(df.withColumnRenamed("doc_id", "t"), id_col="t")


def brute_urls(pages, damping=0.85, tolerance=1e-3, threshold=0.5, trusted=1.0):
    """Verdicts from dense score tables, a seed's own score in full and every round over all edges."""

    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    rows = {}
    for i, url, html in pages:
        host, path = parts(url)
        fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rows[i] = (host, path, max(fits, key=lambda r: len(r.text), default=None), html or "")
    hosts = {h for h, _, _, _ in rows.values() if h}
    good, bad = set(), set()
    by_host = {}
    for h, _, r, _ in rows.values():
        by_host.setdefault(h, []).append(r and r.verdict)
    for h in hosts:
        own = by_host[h]
        a, b = own.count("allow"), own.count("block")
        if a > b:
            good.add(h)
        elif b > a and 2 * b >= len(own):
            bad.add(h)
    links = {}
    for h, _, _, html in rows.values():
        for link in re.findall(r"href=\"((?:http:)?//[^\"]*)\"", html):
            to = parts(link if "://" in link else "x:" + link)[0]
            if h and to and h != to:
                links.setdefault(h, []).append(to)
    trust = dict.fromkeys(good, 1 - damping)
    distrust = dict.fromkeys(bad, 1.0)
    rounds = 1
    while damping**rounds > tolerance:
        rounds += 1
    for _ in range(rounds):
        new = dict.fromkeys(good, 1 - damping)
        for h, score in trust.items():
            for to in links.get(h, []):
                new[to] = new.get(to, 0) + damping * score / len(links[h])
        trust = new
        distrust = {h: damping * sum(distrust.get(to, 0) for to in out) / len(out) for h, out in links.items() if h not in bad} | dict.fromkeys(bad, 1.0)
    mean = sum(trust.get(h, 0) for h in hosts) / max(len(hosts), 1) or 1
    out = {}
    for i, (h, p, r, _) in rows.items():
        t, d = trust.get(h, 0) / mean, distrust.get(h, 0)
        assert abs(d - threshold) > 1e-6 and abs(t - trusted) > 1e-6, "a host on the threshold"
        out[i] = (h, p, r.text if r else None, r.verdict if r else "block" if h and d >= threshold and t < trusted else "allow")
    return out


def test_url_filter(spark):
    rng = random.Random(8)
    names = ["a.net", "b.example.net", "example.com", "c.example.com", "org", "d.org", "E.Com", "f.io", "g.io", "h.io", "i.io"]
    pages = []
    for k in range(200):
        links = "".join(f'<a href="http://{rng.choice(names)}/x">' for _ in range(rng.randint(0, 4)))
        url = f"http://{rng.choice(names)}{rng.choice(['', '/', '/en/1', '/de/2?q#r', '/fr/', '?x=/en/', '/enx'])}"
        pages.append((k, url, rng.choice([links, links, None])))
    pages += [(900, None, None), (901, "no scheme/net", "x"), (902, "", ""), (903, "http://b.net://x/y", ""), (903, "http://b.net://x/y", "")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    want = brute_urls(pages)
    rows = U.filter_urls(df).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == want[r.page_id]
    verdicts = {r.verdict for r in rows if r.rule is None and r.host}
    assert verdicts == {"allow", "block"}
    assert U.filter_urls(df.where("false")).collect() == []


def link(*hosts):
    return "".join(f'<a href="http://{h}/">' for h in hosts)


def test_url_filter_on_farms_and_chains(spark):
    """Distrust fades with the distance from a blocked host, not with the number of those that link to it."""
    pages = [(k, f"http://bad{k}.net/", "") for k in range(3)]
    pages += [(10 + k, f"http://farm{k}.io/", link("bad0.net", "bad1.net", "bad2.net")) for k in range(50)]
    pages += [(100, "http://c0.io/", '<a href="//bad0.net/x">')] + [(100 + k, f"http://c{k}.io/", link(f"c{k - 1}.io")) for k in range(1, 9)]
    pages += [(200, "http://fine.io/", link("bad0.net", *(f"x{k}.io" for k in range(9))))]
    pages += [(300, "http://good.org/fr/", link("noted.io")), (301, "http://noted.io/", link("bad1.net"))]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[10 + k].verdict == "block" and abs(got[10 + k].distrust - 0.85) < 1e-6 for k in range(50))
    assert [got[100 + k].verdict for k in range(9)] == ["block"] * 4 + ["allow"] * 5
    assert [round(got[100 + k].distrust, 6) for k in range(9)] == [round(0.85 ** (k + 1), 6) for k in range(9)]
    assert got[200].verdict == "allow" and got[301].verdict == "allow" and got[301].trust > 1


def test_url_filter_on_a_graph_of_thousands_of_hosts(spark):
    rng = random.Random(12)
    name = lambda k: f"h{k}." + ("net" if k % 20 == 0 else "org" if k % 20 == 1 else "io")
    pages = []
    for k in range(3000):
        near = [name((k // 20) * 20 + rng.randint(0, 19)) for _ in range(3)] if k % 3 else [name((k // 20) * 20)] * 4
        pages.append((k, f"http://{name(k)}/{'fr/' if k % 20 == 1 else ''}", link(*near, name(rng.randint(0, 300)))))
    rows = U.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()
    want = brute_urls(pages)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == want
    assert len({r.page_id for r in rows if r.rule is None and r.verdict == "block"}) > 100
