from __future__ import annotations

import pytest

from plinth.llm import url_filter as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def by_rule(host, path):
    fits = []
    for said, rule in U.RULES:
        own, _, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + start):
            fits.append((len(rule), rule, said))
    return max(fits)[1:] if fits else (None, None)


def scores(links, seeds, iterations=U.ITERATIONS, d=U.DAMPING):
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    trust, distrust = ({h: (1 - d) * s[k] for h, s in seeds.items()} for k in (0, 1))
    base = dict(trust), dict(distrust)
    for _ in range(iterations):
        t, u = dict(base[0]), dict(base[1])
        for (a, b), n in links.items():
            t[b] = t.get(b, 0) + d * trust.get(a, 0) * n / out[a]
            u[a] = u.get(a, 0) + d * distrust.get(b, 0) * n / into[b]
        trust, distrust = t, u
    return trust, distrust


URLS = [
    "http://A.Example.COM/en/7x", "https://a.example.com/en/8", "https://b.example.com/de/1", "http://x.example.net/de/8?y", "http://x.example.net/de/9#z", "https://q.org/es/1",
    "https://q.org/fr/1", "ftp://net/de/", "https://notnet/de/", None, "", "no scheme", "http://?q", "http://host#f", "://h/p", "http://r.org?u=http://x/en/", "http://é.com/en/", "http://com/en",
    "https://s1.org/a", "https://s2.org/a", "https://s3.org/a", "https://s4.org/a",
]


def pages():
    link = {
        "https://s1.org/a": '<a href="https://q.org/x">', "https://s2.org/a": "<a href='//x.example.net/y'><a HREF=https://q.org/1>", "https://b.example.com/de/1": '<a href="http://s3.org/">',
        "http://x.example.net/de/9#z": '<a href="https://s4.org/1"><a href="https://s4.org/2"><a href="/local"><a href="https://x.example.net/own">',
    }
    return [(i, u, link.get(u)) for i, u in enumerate(URLS)]


def test_against_brute_force(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r for r in U.filter_urls(df).collect()}
    links = {("s1.org", "q.org"): 1, ("s2.org", "x.example.net"): 1, ("s2.org", "q.org"): 1, ("b.example.com", "s3.org"): 1, ("x.example.net", "s4.org"): 2}
    count = {}
    for i, u, _ in rows:
        host, path = host_path(u)
        rule, said = by_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        if said and host:
            own = count.setdefault(host, [0, 0])
            own[said == "block"] += 1
    sums = [sum(c[k] for c in count.values()) or 1 for k in (0, 1)]
    trust, distrust = scores(links, {h: (c[0] / sums[0], c[1] / sums[1]) for h, c in count.items()})
    for i, u, _ in rows:
        host, path = host_path(u)
        said = by_rule(host, path)[1] or ("block" if distrust.get(host, 0) > trust.get(host, 0) else "allow")
        assert got[i]["verdict"] == said, u
    assert got[URLS.index("https://s1.org/a")]["verdict"] == "block"  # it links to a blocked host
    assert got[URLS.index("https://s4.org/a")]["verdict"] == "allow"  # an allowed host links to it


def test_propagation(spark):
    links = {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 5, ("c", "a"): 1, ("d", "a"): 3}
    seeds = {"a": (1.0, 0.0), "c": (0.0, 0.7), "d": (0.0, 0.3)}
    edges = spark.createDataFrame([(*k, n) for k, n in links.items()], "src string, dst string, n long")
    own = spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double")
    trust, distrust = scores(links, seeds)
    for r in U.propagate(edges, own).collect():
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-12
        assert abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-12


def test_propagation_goes_on_until_nothing_moves(spark):
    """Trust reaches the end of a chain of forty links; a graph without edges keeps its seeds."""
    edges = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1) for i in range(40)], "src string, dst string, n long")
    own = spark.createDataFrame([("h00", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r["host"]: r["trust"] for r in U.propagate(edges, own).collect()}
    assert len(got) == 41 and all(abs(got[f"h{i:02}"] - 0.15 * 0.85**i) < 1e-12 for i in range(41))
    alone = U.propagate(edges.filter("false"), own).collect()
    assert [(r["host"], round(r["trust"], 12)) for r in alone] == [("h00", 0.15)]


@pytest.mark.parametrize("rules", [(), U.RULES])
def test_empty_and_repeated(spark, rules):
    schema = "page_id long, url string, html string, host string, verdict string, by_rule string"
    assert U.filter_urls(spark.createDataFrame([], schema), rules).count() == 0
    row = (1, "http://a.com/en/1", None, "mine", "mine", "mine")
    got = U.filter_urls(spark.createDataFrame([row, row, (None, None, "<a href=http://a.com>", *["x"] * 3)], schema), rules).collect()
    assert len(got) == 3 and {r["verdict"] for r in got} == ({"allow"} if not rules else {"allow", "block"})
