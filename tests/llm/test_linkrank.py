import re

import pytest

from fiberloom.llm import linkrank
from tests.llm.fixtures import PAGES


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(h) + len(p), v, h + p) for v, h, p in linkrank.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(fits)[1]) if fits else (None, None)


URLS = ["http://a.org/x", "HTTP://A.EXAMPLE.org/es/1?q", "http://example.org/en/12#f", "http://b.example.org/en/2", "http://notexample.org/es/", "http://org/", "http://com/fr/", "http://x.com/de/a/", "http://x.com/en/", "http://x.org", "no scheme", None, "", "://", "http://É.net/É?x", "http://u:1@x.com:80/fr/://z.org/", "http://spam.com/de/1", "http://spam.com/en/2", "http://friend.net/", "http://a.net/\n/x"]


def test_rules(spark):
    html = '<a href="http://spam.com/x">s</a><A HREF=\'//a.org/\'>'
    rows = [(i, u, None if i % 3 else html, "h", "v", "t") for i, u in enumerate(URLS)] + [(0, URLS[0], None, "h", "v", "t")]
    got = linkrank.judge_urls(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parts(URLS[r.page_id])
        name, said = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == said if said else r.verdict in ("allow", "block")


def test_distrust_runs_against_links(spark):
    """Hosts that link to blocked ones are distrusted, hosts that trusted ones link to are trusted."""
    rows = [(1, "http://bad.com/de/1", None), (2, "http://farm.net/", '<a href="http://bad.com/">'), (3, "http://good.org/a", '<a href="http://fine.net/">'), (4, "http://fine.net/", ""), (5, "http://alone.net/", "")]
    got = {r.page_id: r for r in linkrank.judge_urls(spark.createDataFrame([(*r, "h", "v", "t") for r in rows], PAGES)).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["block", "block", "allow", "allow", "allow"]


def test_propagation_against_plain_iteration(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "d", 1.0), ("e", "b", 1.0)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.0), ("d", 0.0, 1.0), ("e", 0.0, 0.0)]
    got = {r.host: (r.trust, r.distrust) for r in linkrank.propagate(spark.createDataFrame(seeds, "host string, s_trust double, s_distrust double"), spark.createDataFrame(edges, "src string, dst string, links double"), rounds=5).collect()}
    t, d = {s[0]: s[1] for s in seeds}, {s[0]: s[2] for s in seeds}
    for _ in range(5):
        out = {h: sum(w for a, _, w in edges if a == h) for h in t}
        into = {h: sum(w for _, b, w in edges if b == h) for h in t}
        t, d = (
            {s[0]: 0.15 * s[1] + 0.85 * sum(t[a] * w / out[a] for a, b, w in edges if b == s[0]) for s in seeds},
            {s[0]: 0.15 * s[2] + 0.85 * sum(d[b] * w / into[b] for a, b, w in edges if a == s[0]) for s in seeds},
        )
    for h in t:
        assert got[h] == pytest.approx((t[h], d[h]))


def test_empty(spark):
    assert linkrank.judge_urls(spark.createDataFrame([], PAGES)).count() == 0


def linked(rnd, hosts):
    """Pages whose links lead to other hosts, with some hosts allowed and some blocked by rules."""
    rows = []
    for i, h in enumerate(hosts):
        for k in range(rnd.randint(1, 3)):
            path = rnd.choice(("/en/", "/de/x", "/fr/y", "/es/z"))
            links = "".join(f'<a class=x href="http://{rnd.choice(hosts)}/p{j}">' for j in range(rnd.randint(0, 4)))
            rows.append((10 * i + k, f"http://{h}{path}", links + "<a href='/own/page'>"))
    return rows


@pytest.mark.parametrize("owners", [False, True])
def test_verdicts_over_links_between_hosts(spark, owners):
    """A table with links between hosts against plain power iteration to the end."""
    import random

    rnd = random.Random(11)
    hosts = [f"h{i}.net" for i in range(12)] + [f"s{i}.site.com" for i in range(6)] + ["example.org", "a.example.org", "good.org"]
    rows = linked(rnd, hosts)
    got = linkrank.judge_urls(spark.createDataFrame([(*r, "h", "v", "t") for r in rows], PAGES), owner_edges=owners).collect()
    seed, edges = {}, {}
    for i, url, html in rows:
        h, p = parts(url)
        said = rule(h, p)[1]
        t = seed.setdefault(h, [0, 0])
        t[0] += said == "allow"
        t[1] += said == "block"
        for to in re.findall('href="http://([^/]*)/', html):
            if to != h:
                edges[h, to] = edges.get((h, to), 0) + 1
    if owners:
        for h in list(seed):
            labels = h.split(".")
            for k in range(len(labels) - 2):
                a, b = ".".join(labels[k:]), ".".join(labels[k + 1 :])
                edges[a, b] = edges.get((a, b), 0) + 1
                edges[b, a] = edges.get((b, a), 0) + 1
    every = set(seed) | {x for e in edges for x in e}
    of = lambda k: {h: seed.get(h, (0, 0))[k] / max(sum(s[k] for s in seed.values()), 1) for h in every}
    ways = [edges, {(b, a): n for (a, b), n in edges.items()}]
    scores = []
    for k in (0, 1):
        total = {h: sum(n for (a, _), n in ways[k].items() if a == h) for h in every}
        now = start = of(k)
        for _ in range(300):
            now = {h: 0.15 * start[h] + 0.85 * sum(now[a] * n / total[a] for (a, b), n in ways[k].items() if b == h) for h in every}
        scores.append(now)
    assert len({r.verdict for r in got if r.rule is None}) == 2
    for r in got:
        t, d = scores[0][r.host], scores[1][r.host]
        assert abs(r.trust - t) < 1e-3 and abs(r.distrust - d) < 1e-3
        if r.rule is None and abs(t - d) > 2e-3:
            assert r.verdict == ("block" if d > t else "allow")


def test_too_few_rounds_are_an_error(spark):
    with pytest.raises(ValueError, match="undealt"):
        linkrank.judge_urls(spark.createDataFrame([], PAGES), rounds=5)


def test_a_long_chain_of_links_is_followed_to_its_end(spark):
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(25)] + [(25, "http://h25.com/de/1", "")]
    rows[24] = (24, "http://h24.net/", '<a href="http://h25.com/">')
    got = {r.page_id: r.verdict for r in linkrank.judge_urls(spark.createDataFrame([(*r, "h", "v", "t") for r in rows], PAGES)).collect()}
    assert set(got.values()) == {"block"}
