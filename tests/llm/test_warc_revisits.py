import random

from sproutscope.llm import warc_revisits as w

SCHEMA = "record_id long, kind string, url string, ts long, status int, headers string"


def head(**fields):
    return "\r\n".join(f"{k.replace('_', '-')}: {v}" for k, v in fields.items())


def test_canonical_urls(spark):
    same = ["http://www.A.com:80/x/?b=2&utm_source=q&a=1#f", "https://a.com/x?a=1&b=2", "a.com/x//?a=1&b=2&ref=z"]
    rows = spark.createDataFrame([(u,) for u in [*same, "http://a.com/X", "http://a.com", None]], "u string")
    got = [r[0] for r in rows.select(w.canonical_url(rows.u)).collect()]
    assert got == ["a.com/x?a=1&b=2"] * 3 + ["a.com/X", "a.com", None]


def test_outcomes_by_hand(spark):
    u = "http://a.com/"
    rows = [
        (1, "response", u, 10, 200, head(ETag='"x"', Content_Type="t", Date="1", Vary="old", Last_Modified="d1")),
        (2, "revisit", "http://www.a.com", 20, 304, head(ETag='W/"x"', Date="2", Content_Type="evil", date="3")),
        (3, "revisit", u, 10, 304, head(ETag='"x"')),
        (4, "response", u, 30, 404, head(ETag='"404"')),
        (5, "revisit", u, 40, 304, head(ETag='"y"')),
        (6, "revisit", u, 41, 304, head(Last_Modified="d1", Expires="soon")),
        (7, "revisit", u, 42, 304, None),
        (8, "response", u, 50, 200, head(ETag='"a"')),
        (9, "response", u, 50, 200, head(ETag='"b"')),
        (10, "revisit", u, 51, 304, head(ETag='"b"')),
        (10, "revisit", u, 51, 304, head(ETag='"b"')),
        (11, "revisit", None, 51, 304, head(ETag='"b"')),
        (12, "revisit", u, None, 304, head(ETag='"b"')),
    ]
    got = {r.record_id: r for r in w.resolve(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS block")).collect()}
    assert {i: (r.outcome, r.resolved_id) for i, r in got.items()} == {
        2: ("resolved", 1),
        3: ("no_response", None),
        5: ("changed", None),
        6: ("resolved", 1),
        7: ("no_validator", None),
        10: ("resolved", 9),
        11: ("no_response", None),
        12: ("no_response", None),
    }
    assert got[2].headers == {"etag": 'W/"x"', "content-type": "t", "date": "3", "vary": "old", "last-modified": "d1"}
    assert got[6].headers["expires"] == "soon" and got[5].headers is None


def test_blocks_of_any_size_give_the_brute_force_answer(spark, monkeypatch):
    rng = random.Random(4)
    responses = [(rng.choice(["hot", "hot", "hot", "b", "c"]), rng.randrange(300), k) for k in range(250)]
    wanted = [(rng.choice(["hot", "b", "c", "none"]), rng.randrange(320)) for _ in range(250)]
    want = {}
    for url, ts in wanted:
        before = [(t, k) for u, t, k in responses if u == url and t < ts]
        want[url, ts] = max(before)[1] if before else None
    for size in (1, 7, 50_000):
        monkeypatch.setattr(w, "POINTS_PER_BLOCK", size)
        found = w.latest_earlier(spark.createDataFrame(responses, "url string, ts long, record_id long"), spark.createDataFrame(wanted, "url string, ts long"))
        assert {(r.url, r.ts): r.earlier for r in found.collect()} == want


def test_empty_table(spark):
    assert w.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
