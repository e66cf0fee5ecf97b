from fractions import Fraction

from sproutscope.llm import link_trust as lt

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_urls_and_rules(spark):
    urls = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "http://x.net": ("x.net", "", None, None),
        "http://x.net?a=/": ("x.net", "", None, None),
        "http://b.org/fr/1#x": ("b.org", "/fr/1", "org/fr/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://com/de/": ("com", "/de/", None, None),
        "x://ÄB.org/a://b": ("Äb.org", "/a://b", None, None),
        "no scheme": ("", "", None, None),
        "": ("", "", None, None),
        "http://": ("", "", None, None),
    }
    rows = [(k, u, None) for k, u in enumerate(urls)] + [(99, None, None)]
    found = {r.url: r for r in lt.with_rule(lt.split_url(pages(spark, rows)), RULES).collect()}
    for url, want in urls.items():
        r = found[url]
        assert (r.host, r.path, r.rule, r.rule_verdict) == want, url
    assert (found[None].host, found[None].path, found[None].rule) == ("", "", None)


def brute_rank(edges, seeds, steps):
    """The same integer steps on plain dictionaries."""
    if not seeds:
        return {}
    out = {}
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    seed = lt.MASS * lt.FINE // len(seeds)
    mass = {s: seed for s in seeds}
    for _ in range(steps):
        after = {s: seed * (100 - lt.DAMPING) // 100 for s in seeds}
        for (a, b), n in edges.items():
            if a in mass:
                after[b] = after.get(b, 0) + mass[a] * n // out[a] * lt.DAMPING // 100
        mass = after
    return mass


def spread(spark, edges, hosts):
    """({host: mass}, steps) of one kind."""
    table = spark.createDataFrame([("allow", a, b, n) for (a, b), n in edges.items()], "kind string, source string, target string, n long")
    ranks, steps = lt.spread(table, spark.createDataFrame([("allow", h) for h in hosts], "kind string, host string"))
    return {r.host: int(r.mass) for r in ranks.collect()}, steps


def link(*targets):
    return "".join(f"<p><a class=x href='{t}'>t</a>" for t in targets)


def test_trust_spreads_and_hosts_are_judged(spark):
    rows = [
        (1, "http://good.org/fr/a", link("http://friend.com/x", "/own", "//friend.com/y")),
        (2, "http://good.org/fr/b", link("http://friend.com/z")),
        (3, "http://friend.com/a", link("https://far.io:8080/")),
        (4, "http://bad.net/a", None),
        (5, "http://spam.io/a", link("http://bad.net/a", "http://bad.net/b")),
        (6, "http://farm.io/a", link("http://spam.io/a")),
        (7, "http://far.io:8080/a", ""),
        (8, "http://alone.io/", "<a>no link</a><link href='http://bad.net/'>"),
        (9, None, link("http://bad.net/")),
        (9, None, None),
    ]
    table = pages(spark, rows).selectExpr("*", "'x' AS verdict", "1 AS trust")
    got = lt.judge(table, RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].verdict for i in range(1, 10)] == ["allow", "allow", "allow", "block", "block", "block", "allow", "allow", "allow"]
    edges = {("good.org", "friend.com"): 3, ("friend.com", "far.io:8080"): 1, ("spam.io", "bad.net"): 2, ("farm.io", "spam.io"): 1}
    trust = brute_rank(edges, ["good.org"], got[0].steps)
    distrust = brute_rank({(b, a): n for (a, b), n in edges.items()}, ["bad.net"], got[0].steps)
    for r in got:
        assert (r.trust, r.distrust) == (trust.get(r.host, 0) // lt.FINE, distrust.get(r.host, 0) // lt.FINE), r.host


def test_a_hub_of_millions_of_links_loses_no_target(spark):
    """Exact fractions by hand, and a chain of rare links that ends far below 1e-12."""
    edges = {("hub", "much"): 1_999_999, ("hub", "rare"): 1, ("rare", "end"): 1}
    edges |= {(f"c{k}", f"c{k + 1}"): 1 for k in range(5)} | {(f"c{k}", "else"): 9_999 for k in range(5)}
    got, steps = spread(spark, edges, ["hub", "c0"])
    out, seed = {}, Fraction(lt.MASS * lt.FINE, 2)
    for (a, _), n in edges.items():
        out[a] = out.get(a, 0) + n
    want = {"hub": seed, "c0": seed}
    for _ in range(steps):
        after = {h: seed * (100 - lt.DAMPING) / 100 for h in ("hub", "c0")}
        for (a, b), n in edges.items():
            after[b] = after.get(b, 0) + want.get(a, 0) * n / out[a] * lt.DAMPING / 100
        want = after
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) <= 1000 for h in want)
    assert got["rare"] > 0 and got["end"] > 0 and got["c5"] > 0


def test_few_links_far_from_many_seeds_are_not_lost(spark):
    """No host has many links, but whole 1e-12ths would run out on the way."""
    edges = {(f"c{k}", f"c{k + 1}"): 1 for k in range(5)} | {(f"c{k}", "else"): 999 for k in range(5)}
    assert spread(spark, edges, ["c0"])[0]["c5"] > 0


def test_steps_end_when_masses_settle(spark):
    """A chain without a way back settles once it is walked; a circle goes on until little moves."""
    chain, steps = spread(spark, {(f"c{k}", f"c{k + 1}"): 1 for k in range(15)}, ["c0"])
    assert steps == 24 and chain["c15"] > 0 and lt.TOLERANCE * abs(sum(chain.values()) - lt.MASS * lt.FINE) < 100 * lt.MASS * lt.FINE
    circle = {(f"c{k}", f"c{(k + 1) % 3}"): 1 for k in range(3)}
    found, steps = spread(spark, circle, ["c0"])
    further = brute_rank(circle, ["c0"], 200)
    assert found == brute_rank(circle, ["c0"], steps) and steps <= 48
    assert sum(abs(found[h] - further[h]) for h in found) < 0.4 * lt.MASS * lt.FINE / lt.TOLERANCE
    assert spread(spark, circle, [])[1] == 0


def test_a_hot_host_does_not_hide_who_links_to_bad_hosts(spark):
    rows = [(1, "http://bad.net/", None), (2, "http://small.io/", link("http://bad.net/"))]
    edges = spark.createDataFrame([("hot.io", "bad.net", 3_000_000), ("small.io", "bad.net", 1)], "source string, target string, n long")
    kept = lt.links
    lt.links = lambda pages: edges
    try:
        got = {r.page_id: r.verdict for r in lt.judge(pages(spark, rows), RULES).collect()}
    finally:
        lt.links = kept
    assert got == {1: "block", 2: "block"}


def test_empty_table_and_no_python(spark):
    out = lt.judge(pages(spark, []), RULES)
    assert out.count() == 0
    plan = lt.judge(pages(spark, [(1, "http://a.org/", link("http://b.org"))]), RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
