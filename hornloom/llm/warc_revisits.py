"""Not-modified revisits resolved to the latest earlier full response of the same canonical URL (as-of join).

Records have record_id, kind ('response' or 'revisit'), uri, time (long), status, etag, last_modified, headers (map) and payload. A revisit
is matched with the latest response of its canonical URL whose time is before its own (or equal, with a smaller record_id). If both have an
ETag these must be equal (weak comparison: a leading W/ does not count); else, if both have Last-Modified, these must be equal. A match
takes the response's payload digest and headers, with those headers that a 304 may update replaced by the revisit's own.

The as-of join goes by (URL, chunk of its timeline). Counts by URL (map-side) tell the hot ones; only these get cut points, quantiles of their capture
times, so a chunk has about CHUNK_ROWS captures also where they come in bursts (captures of one URL at one instant are not cut). The
cut points are as many as the hot URLs' captures over CHUNK_ROWS; they are broadcast up to BROADCAST_CUTS, else joined. The latest response of each
chunk is aggregated first, and only those few rows are carried over chunk borders. So no task gets all captures of a hot URL,
and the payloads are never shuffled: only digests and headers travel. Records without URL or time take no part in the join.

Defined cases: a null uri matches nothing (status `orphan`); null time or kind likewise take no part as a response, and such a revisit is an orphan. A revisit
with no earlier response is an `orphan`, one whose validators differ is a `mismatch`, and one without comparable validators is
`unverified` (not merged). Among responses with equal time the largest record_id is the latest. Repeated revisits are resolved each on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornloom.llm._shared import settle

#: Header fields that a 304 answer may update (lower case), and query parameters that name no content.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)"
#: Production parameters: captures of a chunk, most chunks of a URL, cut points that are broadcast (8 bytes each).
CHUNK_ROWS, CHUNKS, BROADCAST_CUTS = 4096, 1000, 1_000_000


def canonical(uri: Column) -> Column:
    """scheme and www. dropped, host in lower case without a default port, no fragment, no tracking parameters, others sorted, no closing slash."""
    bare = F.regexp_replace(F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\d*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(host, path, tail)


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def _cuts(r: DataFrame, chunk_rows: int) -> DataFrame | None:
    """canonical_uri, _cuts (array of times) of the URLs with more captures than a chunk; None without such URLs."""
    counts = r.groupBy("canonical_uri").agg(F.count("*").alias("n")).where(F.col("n") > chunk_rows)
    hot = settle(counts.select("canonical_uri", F.least(F.ceil(F.col("n") / chunk_rows), F.lit(CHUNKS)).cast("int").alias("parts")), "hot-urls")
    total = hot.agg(F.sum("parts")).first()[0]
    if total is None:
        return None
    few = total <= BROADCAST_CUTS
    quantiles = r.join(F.broadcast(hot) if few else hot, "canonical_uri").groupBy("canonical_uri").agg(F.max("parts").alias("parts"), F.percentile_approx("time", [i / CHUNKS for i in range(1, CHUNKS)]).alias("q"))
    # Every (CHUNKS / parts)-th of the quantiles; equal ones are one border.
    picked = F.transform(F.sequence(F.lit(1), F.col("parts") - 1), lambda i: F.get("q", F.floor(i * CHUNKS / F.col("parts")).cast("int") - 1))
    cuts = settle(quantiles.select("canonical_uri", F.array_distinct(F.when(F.col("parts") > 1, picked).otherwise(F.array().cast("array<long>"))).alias("_cuts")), "cuts")
    return F.broadcast(cuts) if few else cuts


def resolve(records: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row for each revisit: record_id, canonical_uri, status (resolved, mismatch, unverified, orphan), response_id, digest, headers (sorted text)."""
    r = records.select("record_id", "kind", F.col("uri").alias("_u"), "time", "etag", "last_modified", "headers", F.md5("payload").alias("digest"))
    r = r.withColumn("canonical_uri", canonical(F.col("_u"))).drop("_u")
    alone = r.where(F.col("canonical_uri").isNull() | F.col("time").isNull()).where(F.col("kind") == "revisit")
    r = r.where(F.col("canonical_uri").isNotNull() & F.col("time").isNotNull())
    cuts = _cuts(r, chunk_rows)
    chunk = F.lit(0)
    if cuts is not None:
        # Each capture's chunk is the number of its URL's cut points that are at most its time.
        r = r.join(cuts, "canonical_uri", "left")
        chunk = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("time"))), F.lit(0))
    r = r.withColumn("_chunk", chunk).drop("_cuts")
    full = F.when(F.col("kind") == "response", F.struct("time", "record_id", "etag", "last_modified", "digest", F.map_entries("headers").alias("headers")))
    r = r.withColumn("_full", full)
    chunks = r.where(F.col("_full").isNotNull()).groupBy("canonical_uri", "_chunk").agg(F.max_by("_full", F.struct("time", "record_id")).alias("_latest"))
    # The latest response of all earlier chunks, also for chunks that have revisits only.
    grid = r.select("canonical_uri", "_chunk").distinct().join(chunks, ["canonical_uri", "_chunk"], "left")
    earlier = Window.partitionBy("canonical_uri").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select("canonical_uri", "_chunk", F.last("_latest", ignorenulls=True).over(earlier).alias("_carried"))
    order = Window.partitionBy("canonical_uri", "_chunk").orderBy("time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = r.withColumn("_near", F.last("_full", ignorenulls=True).over(order)).where(F.col("kind") == "revisit")
    m = near.join(carried, ["canonical_uri", "_chunk"], "left").withColumn("_r", F.coalesce("_near", "_carried"))
    tags = (F.col("etag").isNotNull() & F.col("_r.etag").isNotNull(), _tag(F.col("etag")) == _tag(F.col("_r.etag")))
    dates = (F.col("last_modified").isNotNull() & F.col("_r.last_modified").isNotNull(), F.col("last_modified") == F.col("_r.last_modified"))
    checked = F.when(tags[0], tags[1]).when(dates[0], dates[1])
    status = F.when(F.col("_r").isNull(), "orphan").when(checked.isNull(), "unverified").when(checked, "resolved").otherwise("mismatch")
    own = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: F.lower(k).isin(*PERMITTED))
    low = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    base = F.transform(F.coalesce("_r.headers", F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(e.key).alias("key"), e.value.alias("value")))
    names = F.transform(low(own), lambda e: e.key)
    merged = F.array_sort(F.concat(F.filter(base, lambda e: ~F.array_contains(names, e.key)), low(own)))
    text = F.array_join(F.transform(merged, lambda e: F.concat(e.key, F.lit(": "), F.coalesce(e.value, F.lit("")))), "\n")
    m = m.withColumn("status", status)
    good = F.col("status") == "resolved"
    found = m.select("record_id", "canonical_uri", "status", F.when(good, F.col("_r.record_id")).alias("response_id"), F.when(good, F.col("_r.digest")).alias("digest"), F.when(good, text).alias("headers"))
    return found.unionByName(alone.select("record_id", "canonical_uri", F.lit("orphan").alias("status")), allowMissingColumns=True)


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of all pages: every page gives a full response, and a not-modified revisit of its URL some time later.

    The ETag names the payload, so a revisit is stale once a later response of the same canonical URL with another payload came between.
    Derived from the page alone: the revisit comes 1 to 5,000 time units after its response, on every 9th page before it. Pages longer than 2,000
    characters send no ETag on the revisit but the same Last-Modified; every 7th page's revisit sends another ETag and every 11th page's no validator.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 12), F.lit('"'))
    day = F.concat(F.lit("day "), F.pmod(F.col("page_id"), F.lit(28)).cast("string"))
    long = F.length(html) > 2000
    every = lambda n, k: F.coalesce(F.col("page_id") % n == k, F.lit(False))
    at = F.col("page_id") * 10 + F.when(every(9, 4), -7).otherwise(1 + F.length(html) % 5000)
    none = F.lit(None).cast("string")
    sent = F.when(long | every(11, 3), none).when(every(7, 2), '"another"').otherwise(tag)
    day_sent = F.when(every(11, 3), none).otherwise(day)
    text = lambda *x: F.create_map(*(y if not isinstance(y, str) else F.lit(y) for y in x))
    response = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("kind"), F.col("url").alias("uri"), (F.col("page_id") * 10).alias("time"), F.lit(200).alias("status"), tag.alias("etag"), day.alias("last_modified"),
        text("Content-Type", "text/html", "ETag", tag, "Last-Modified", day, "Date", F.col("page_id").cast("string")).alias("headers"), html.alias("payload"))
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("kind"), F.col("url").alias("uri"), at.alias("time"), F.lit(304).alias("status"), sent.alias("etag"), day_sent.alias("last_modified"),
        text("Content-Type", "text/plain", "Date", F.concat(F.lit("r"), F.col("page_id").cast("string")), "Cache-Control", "max-age=60").alias("headers"), F.lit(None).cast("string").alias("payload"))
    return pages.select(F.inline(F.array(response, revisit)))


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '', 's') AS bare FROM p),
c AS (SELECT page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), '^www\d*\.', ''), ':(80|443)$', '') AS host,
             regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
             list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS kept FROM b),
u AS (SELECT page_id, html, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_uri FROM c),
f AS (SELECT canonical_uri, page_id * 2 AS id, page_id * 10 AS t, '"' || substr(md5(html), 1, 12) || '"' AS tag, 'day ' || CAST(page_id % 28 AS VARCHAR) AS day, md5(html) AS digest, page_id FROM u),
v AS (SELECT canonical_uri, page_id * 2 + 1 AS id, page_id * 10 + CASE WHEN page_id % 9 = 4 THEN -7 ELSE 1 + length(html) % 5000 END AS t,
             CASE WHEN length(html) > 2000 OR page_id % 11 = 3 THEN NULL WHEN page_id % 7 = 2 THEN '"another"' ELSE '"' || substr(md5(html), 1, 12) || '"' END AS tag,
             CASE WHEN page_id % 11 = 3 THEN NULL ELSE 'day ' || CAST(page_id % 28 AS VARCHAR) END AS day, page_id FROM u),
j AS (SELECT v.*, f.id AS fid, f.tag AS ftag, f.day AS fday, f.digest, row_number() OVER (PARTITION BY v.id ORDER BY f.t DESC, f.id DESC) AS k
      FROM v LEFT JOIN f ON v.canonical_uri = f.canonical_uri AND (f.t < v.t OR (f.t = v.t AND f.id < v.id))),
s AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN tag IS NOT NULL THEN (CASE WHEN tag = ftag THEN 'resolved' ELSE 'mismatch' END) WHEN day IS NULL THEN 'unverified' WHEN day = fday THEN 'resolved' ELSE 'mismatch' END AS status FROM j WHERE k = 1)
SELECT id AS record_id, canonical_uri, status, CASE WHEN status = 'resolved' THEN fid END AS response_id, CASE WHEN status = 'resolved' THEN digest END AS digest,
       CASE WHEN status = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-type: text/html' || chr(10) || 'date: r' || CAST(page_id AS VARCHAR) || chr(10) || 'etag: ' || ftag || chr(10) || 'last-modified: ' || fday END AS headers
FROM s"""
