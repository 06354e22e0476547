import random
import re
from collections import Counter

import pytest
from whence.llm import urls as U


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def rule_of(host, path):
    fit = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def brute_rank(links, seeds, rounds):
    total = sum(seeds.values())
    if not total:
        return {}
    out = Counter()
    for (s, _), n in links.items():
        out[s] += n
    rank = {h: v / total for h, v in seeds.items()}
    for _ in range(rounds):
        new = Counter({h: 0.15 * v / total for h, v in seeds.items()})
        for (s, d), n in links.items():
            new[d] += 0.85 * rank.get(s, 0) * n / out[s]
        rank = new
    return rank


PAGES = [(1, None, "x"), (2, "no scheme", None), (3, "http://WWW.Example.NET/en/a?x#y", ""), (4, "http://net/", None), (5, "http://net", None), (6, "HTTP://É.org/fr/\nz", "y"), (7, "http://example.com/de/", ""), (8, "http://notexample.com/de/", ""), (8, "http://notexample.com/de/", ""), (9, "a://b://c/d", ""), (None, "http://x.net/a", "")]


def graph_pages(seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.example.{t}" for i in range(12) for t in ("com", "org", "net")] + ["example.com", "a.h1.example.com"]
    rows = list(PAGES)
    for i in range(200):
        links = "".join(f'<a class=x HREF="{rng.choice(["http:", "", "https:"])}//{rng.choice(hosts)}/p">t</a> <a href="/rel">' for _ in range(rng.randint(0, 3)))
        rows.append((100 + i, f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}", links))
    return rows


def test_against_brute_force(spark):
    rows = graph_pages(1)
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    links, allowed, blocked, hosts = Counter(), Counter(), Counter(), set()
    for _, url, html in rows:
        host, path = parts(url)
        hosts.add(host)
        if r := rule_of(host, path):
            (allowed if r.verdict == "allow" else blocked)[host] += 1
        for m in re.finditer(r'(?i)<a\s[^>]*?href="([^"]*)"', html or ""):
            if "//" in m[1]:
                t, _ = parts(m[1] if "://" in m[1] else "http:" + m[1])
                if t != host and t and host:
                    links[host, t] += 1
    for h in hosts:
        p = h.partition(".")[2]
        if "." in p and p in hosts:
            links[h, p] += 1
            links[p, h] += 1
    assert {(r.src, r.dst): r.n for r in U.host_links(df).collect()} == dict(links)
    trust = brute_rank(links, allowed, 6)
    distrust = brute_rank({(d, s): n for (s, d), n in links.items()}, blocked, 6)
    top = max(trust.values()), max(distrust.values())
    got = U.judge(df, rounds=6).collect()
    assert len(got) == len(rows)
    assert sorted(((r.page_id, r.host, r.path) for r in got), key=str) == sorted(((k, *parts(u)) for k, u, _ in rows), key=str)
    for r in got:
        t, d = trust.get(r.host, 0) / top[0], distrust.get(r.host, 0) / top[1]
        assert (r.trust, r.distrust) == pytest.approx((t, d))
        rule = rule_of(r.host, r.path)
        assert r.rule == (rule and rule.name)
        if rule or abs(t - d) > 1e-9:
            assert r.verdict == (rule.verdict if rule else "block" if d > t else "allow")


def test_rounds_go_on_until_ranks_settle(spark):
    links = {("a", "b"): 3, ("b", "a"): 1, ("b", "c"): 1, ("c", "a"): 5, ("d", "a"): 1}
    rows = [("one", *k, n) for k, n in links.items()] + [("two", d, s, n) for (s, d), n in links.items()]
    seeds = [("one", "a", 2.0), ("one", "d", 1.0), ("two", "c", 1.0)]
    got = U.personalised_pagerank(spark.createDataFrame(rows, "side string, src string, dst string, n long"), spark.createDataFrame(seeds, "side string, host string, seed double")).collect()
    want = brute_rank(links, {"a": 2.0, "d": 1.0}, 400), brute_rank({(d, s): n for (s, d), n in links.items()}, {"c": 1.0}, 400)
    for r in got:
        assert r["rank"] == pytest.approx(want[r.side == "two"][r.host], abs=2e-6)
    assert len(got) == sum(v > 0 for w in want for v in w.values())


def test_links_that_no_reader_sees(spark):
    html = '<!-- <a href="http://x.y/"> --><script>"<a href=http://s.y/>"</script ><STYLE><a href=http://t.y/></style><a href="http://z.y/">z</a><!-- <a href="http://open.y/">'
    df = spark.createDataFrame([("http://a.b/", html)], "url string, html string")
    assert [tuple(r) for r in U.host_links(df).collect()] == [("a.b", "z.y", 1)]


def test_no_links_no_seeds_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", None), (2, None, None)], "page_id long, url string, html string")
    assert {(r.page_id, r.rule, r.verdict) for r in U.judge(df, rounds=2).collect()} == {(1, None, "allow"), (2, None, "allow")}
    assert U.judge(df.limit(0), rounds=2).collect() == []
