"""Not-modified revisits of web archives, resolved to the response they repeat.

A revisit record holds the headers of a 304 answer and no body. Its body is that of the latest
earlier full response (status 200) to the same canonical url, if the validators agree: entity tags
compared weakly where both have one, else modification dates where both have one. The 304's headers
that may change without the body replace those of the stored response.

The as-of join runs on distinct (url, time) points without bodies. Points of a url are cut into blocks
of time, so a url with very many captures is spread over many groups; each block looks back inside
itself first, and else takes what the blocks before it ended with.

Defined cases: a revisit without an earlier response is ``no_response``; with one whose validators
differ ``changed``, with none to compare ``no_validator``; a null url or time never matches; responses
of one url and time count as the one of the greatest record_id; repeated record ids are kept once;
null headers are empty; an empty table gives an empty result; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sproutscope.session import stage

#: Headers of a 304 answer that update a stored response (fixed by the HTTP caching rules).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that don't change the page.
TRACKING = r"(utm_[a-z]+|fbclid|gclid|ref)"
POINTS_PER_BLOCK = 50_000


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``, default port, fragment, tracking parameters and trailing slash; host in lower case."""
    rest = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def parse_headers(block: Column) -> Column:
    """A map of lower-case names from a block of ``Name: value`` lines; of equal names the last stays."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), "\r?\n"), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def _blocked(points: DataFrame) -> DataFrame:
    """Points (url, ts, …) with ``block``: a slice of the url's time span, fewer than so many points if times are even."""
    spans = points.groupBy("url").agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    width = F.expr(f"(hi - lo) DIV ((n - 1) DIV {POINTS_PER_BLOCK} + 1) + 1")
    spans = spans.select("url", "lo", width.alias("width"))
    return points.join(spans, "url").withColumn("block", F.expr("(ts - lo) DIV width")).drop("lo", "width")


def latest_earlier(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """(url, ts, earlier): for each distinct wanted point the record of the latest response before it.

    ``responses``: url, ts, record_id; ``wanted``: url, ts.
    """
    given = responses.where("url IS NOT NULL AND ts IS NOT NULL").groupBy("url", "ts").agg(F.max("record_id").alias("record"))
    asked = wanted.where("url IS NOT NULL AND ts IS NOT NULL").distinct()
    points = given.select("url", "ts", "record", F.lit(False).alias("asked")).unionByName(asked.select("url", "ts", F.lit(None).cast("long").alias("record"), F.lit(True).alias("asked")))
    points = stage(_blocked(points), "capture-points")
    # at equal times the asked point comes first: a response at that very time isn't earlier
    inside = Window.partitionBy("url", "block").orderBy("ts", F.col("asked").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = points.withColumn("inside", F.last("record", ignorenulls=True).over(inside)).where("asked")
    ends = points.groupBy("url", "block").agg(F.max(F.when(~F.col("asked"), F.struct("ts", "record")))["record"].alias("last"))
    before = Window.partitionBy("url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("url", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    return own.join(carried, ["url", "block"]).select("url", "ts", F.coalesce("inside", "carried").alias("earlier"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit with the response it repeats.

    ``records``: record_id long, kind (response or revisit), url, ts long, status int, headers (block of
    lines). Returns record_id, resolved_id (null unless resolved), outcome, headers (map) and, for a
    look at the body, nothing: bodies are joined by ``resolved_id`` where they are needed.
    """
    rows = records.dropDuplicates(["record_id"]).select("record_id", "kind", canonical_url(F.col("url")).alias("url"), "ts", "status", parse_headers(F.col("headers")).alias("headers"))
    rows = stage(rows, "captures")
    responses = rows.where("kind = 'response' AND status = 200")
    revisits = rows.where("kind = 'revisit'")
    found = latest_earlier(responses.select("url", "ts", "record_id"), revisits.select("url", "ts"))
    stored = responses.select(F.col("record_id").alias("earlier"), F.col("headers").alias("stored"))
    joined = revisits.join(found, ["url", "ts"], "left").join(stored, "earlier", "left")
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    tag, old_tag = weak(F.col("headers")["etag"]), weak(F.col("stored")["etag"])
    date, old_date = F.col("headers")["last-modified"], F.col("stored")["last-modified"]
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(date.isNotNull() & old_date.isNotNull(), date == old_date)
    outcome = F.when(F.col("earlier").isNull(), "no_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("changed")
    allowed = F.map_filter("headers", lambda k, v: k.isin(PERMITTED))
    kept = F.map_filter("stored", lambda k, v: ~F.map_contains_key(allowed, k))
    merged = F.when(F.col("outcome") == "resolved", F.map_concat(kept, allowed))
    return joined.withColumn("outcome", outcome).select(
        "record_id", F.when(F.col("outcome") == "resolved", F.col("earlier")).alias("resolved_id"), "outcome", merged.alias("headers")
    )
