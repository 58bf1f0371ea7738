"""URL rules and the walk over hosts against plain Python."""

import pytest

from drawloom.llm import link_graph as lg
from drawloom.llm.catalog import QUERIES


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    return host, path


def ruled(host, path):
    best = None
    for r in lg.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


URLS = [None, "", "x", "http://", "http://a.net", "http://A.Net/", "https://x.example.net/en/1?q#f", "ftp://example.net/en", "http://example.com/de/x", "http://sub.example.com/de/", "http://badexample.com/de/", "http://a.org/fr/z", "http://org/fr/", "http://a.org:80/fr/", "http://é.NET/É?x=://y", "a://b://c/d", "http://h/p#a?b", "http://h?x/y", "http://q\n.net/a\nb"]


def brute(pages):
    edges, seeds, judged = {}, {}, []
    import re

    for page, url, html in pages:
        host, path = parse(url)
        rule = ruled(host, path)
        judged.append((page, host, path, rule))
        if host:
            s = seeds.setdefault(host, [0, 0, 0])
            s[0] += bool(rule and rule.verdict == "allow")
            s[1] += bool(rule and rule.verdict == "block")
            s[2] += 1
            for b in {t.lower() for t in re.findall(lg._TARGET, html or "")} - {host}:
                edges[host, b] = edges.get((host, b), 0) + 1
    hosts = {*seeds, *(h for e in edges for h in e)}
    totals = [sum(s[k] for s in seeds.values()) for k in range(3)]
    start = {h: [seeds.get(h, [0, 0, 0])[k] / totals[k] if totals[k] else 0.0 for k in range(3)] for h in hosts}
    state = dict(start)
    for _ in range(300 if edges else 0):
        new = {h: [(1 - lg.DAMPING) * x for x in start[h]] for h in hosts}
        for (a, b), w in edges.items():
            forward = w / sum(v for (x, _), v in edges.items() if x == a)
            back = w / sum(v for (_, y), v in edges.items() if y == b)
            new[b][0] += lg.DAMPING * forward * state[a][0]
            new[a][1] += lg.DAMPING * back * state[b][1]
            new[b][2] += lg.DAMPING * forward * state[a][2]
        state = new
    sums = [sum(s[k] for s in state.values()) or 1 for k in range(3)]
    out = []
    for page, host, path, rule in judged:
        t, d, b = (x / s for x, s in zip(state.get(host, [0, 0, 0]), sums, strict=True))
        out.append((page, host, path, rule.name if rule else None, rule.verdict if rule else "block" if d > t and d > lg.LIFT * b else "allow", t, d))
    return sorted(out, key=repr)


def run(spark, pages):
    df = spark.createDataFrame([(p, u, h, "r", 0.0) for p, u, h in pages], "page_id long, url string, html string, rule string, trust double")
    return sorted((tuple(r) for r in lg.judge(df).collect()), key=repr)


def same(got, truth):
    assert [g[:5] for g in got] == [t[:5] for t in truth]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for t in truth for x in t[5:]], abs=1e-8)


def link(*hosts):
    return "".join(f'<a class=x HREF="https://{h}/z">x</a>' for h in hosts)


def test_rules_without_links(spark):
    same(run(spark, [(k, u, None) for k, u in enumerate(URLS)]), brute([(k, u, None) for k, u in enumerate(URLS)]))
    assert run(spark, []) == []


def test_walk(spark):
    pages = [(k, f"http://hub.com/{k}", link("b.com", "C.com")) for k in range(30)]
    pages += [(100, "http://spam.com/", link("a.net", "b.net")), (101, "http://good.org/fr/", link("b.com", "good.org")), (102, "http://b.com/x", link("c.com") + "<a href='//d.com'>"), (103, "http://a.net/", link("a.net")), (103, "http://a.net/", link("c.com"))]
    got = run(spark, pages)
    same(got, brute(pages))
    assert {g[4] for g in got if g[1] == "spam.com"} == {"block"} and {g[4] for g in got if g[1] == "b.com"} == {"allow"}


def test_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    same(sorted((tuple(r) for r in QUERIES["op4_url_filters"](spark, "/root/testdata/sf0.001").collect()), key=repr), brute(pages))
