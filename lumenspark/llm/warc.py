"""Revisit resolution for web archive records, in DataFrame functions only.

A record of type ``revisit`` says "not modified" and holds no payload. It is resolved to the latest
earlier ``response`` of the same canonical URL, provided that the validators agree (entity tag where
both have one, else Last-Modified where both have one). The resolved record takes the response's
payload fields; its headers are the response's, with those that a 304 reply may update
(UPDATABLE) taken from the revisit.

The as-of join is exact: time is cut into SPANS spans of about as many records each, each
(URL, span) keeps its latest response, these few summaries are carried forward per URL, and only
within a span are records ordered among themselves. So a task has about 1 / SPANS of a URL's records,
unless more of them than that bear the very same time. Header names are compared without regard to case.

Edge cases: a null URL matches nothing, and such records meet in no window; a null time sorts first; at equal times a revisit precedes a
response, and of responses the greatest record_id is the latest; repeated rows each give a row; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 reply sends to update a stored response (RFC 9110, 15.4.5, and RFC 9111, 3.2).
UPDATABLE = ("cache-control", "content-location", "date", "etag", "expires", "vary")
SPANS = 256


def canonical_url(url):
    """Without scheme, user, default port, leading www., fragment and trailing slashes; host in lower case, query fields sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^([^/?]*)", 1)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(host, "^.*@", "")), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    fields = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), fields)).otherwise(F.lit("")))


def resolve(records: DataFrame, spans: int = SPANS) -> DataFrame:
    """One row per revisit of records(record_id, kind, url, at, etag, last_modified, headers map, payload_digest, payload_length).

    Returns record_id, url_key, status (resolved, validator_mismatch, no_response), resolved_id,
    headers, payload_digest, payload_length; the last four are null unless resolved.
    """
    r = records.select("record_id", "kind", "at", "etag", "last_modified", "headers", "payload_digest", "payload_length", canonical_url(F.col("url")).alias("url_key"))
    # approximate quantiles: any cuts give the same result
    known = r.where(F.col("at").isNotNull()).select(F.col("at").cast("double").alias("at"))
    cuts = sorted(set(known.approxQuantile("at", [i / spans for i in range(1, spans)], 0.5 / spans))) if spans > 1 else []
    r = r.withColumn("span", F.when(F.col("at").isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("at").cast("double"))) if cuts else F.lit(0)))
    placed = r.where(F.col("url_key").isNotNull())
    is_response = F.col("kind") == "response"
    answer = F.struct("at", "record_id", "etag", "last_modified", "headers", "payload_digest", "payload_length")
    # max_by orders by (at, record_id) alone, as maps have no order
    latest = (
        placed
        .groupBy("url_key", "span")
        .agg(F.max_by(F.when(is_response, answer), F.when(is_response, F.struct("at", "record_id"))).alias("last"))
    )
    before = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url_key", "span", F.last("last", ignorenulls=True).over(before).alias("carried"))
    within = Window.partitionBy("url_key", "span").orderBy("at", F.when(is_response, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("own", F.last(F.when(is_response, answer), ignorenulls=True).over(within)).where(F.col("kind") == "revisit")
    joined = own.join(carried, ["url_key", "span"], "left").withColumn("a", F.coalesce("own", "carried"))
    nowhere = r.where(F.col("url_key").isNull() & (F.col("kind") == "revisit"))
    joined = joined.unionByName(nowhere, allowMissingColumns=True)
    both = lambda c: F.col(c).isNotNull() & F.col(f"a.{c}").isNotNull()
    agrees = F.when(both("etag"), F.col("etag") == F.col("a.etag")).when(both("last_modified"), F.col("last_modified") == F.col("a.last_modified")).otherwise(F.lit(False))
    status = F.when(F.col("a").isNull() | F.col("url_key").isNull(), "no_response").when(agrees, "resolved").otherwise("validator_mismatch")
    ok = F.col("status") == "resolved"
    empty = F.create_map().cast("map<string,string>")
    allowed = F.map_filter(F.coalesce("headers", empty), lambda k, _: F.lower(k).isin(*UPDATABLE))
    replaced = F.transform(F.map_keys(allowed), F.lower)
    kept = F.map_filter(F.coalesce(F.col("a.headers"), empty), lambda k, _: ~F.array_contains(replaced, F.lower(k)))
    return joined.withColumn("status", status).select(
        "record_id",
        "url_key",
        "status",
        F.when(ok, F.col("a.record_id")).alias("resolved_id"),
        F.when(ok, F.map_concat(kept, allowed)).alias("headers"),
        F.when(ok, F.col("a.payload_digest")).alias("payload_digest"),
        F.when(ok, F.col("a.payload_length")).alias("payload_length"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Archive records over pages(page_id, url, html): each page's response, and a later not-modified revisit of it.

    Time is the page's number; the revisit comes 500 ticks later, so that pages of the same canonical
    URL interleave and some revisits meet a changed response first.
    """
    digest = F.md5(F.col("html"))
    head = lambda *more: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in more])
    base = pages.select("page_id", "url", digest.alias("digest"), F.length("html").cast("long").alias("n"))
    both = base.withColumn("kind", F.explode(F.array(F.lit("response"), F.lit("revisit"))))
    first = F.col("kind") == "response"
    at = F.col("page_id") + F.when(first, 0).otherwise(500)
    return both.select(
        (F.col("page_id") * 2 + F.when(first, 0).otherwise(1)).alias("record_id"),
        "kind",
        "url",
        at.alias("at"),
        F.col("digest").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(first, head("content-type", "text/html", "etag", F.col("digest"), "date", at.cast("string"))).otherwise(head("etag", F.col("digest"), "date", at.cast("string"), "server", "cache")).alias("headers"),
        F.when(first, F.col("digest")).alias("payload_digest"),
        F.when(first, F.col("n")).alias("payload_length"),
    )


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The revisits of captures(pages), with headers as sorted name=value lines."""
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n")
    return resolve(captures(pages)).withColumn("headers", lines)


_KEY = r"""
  SELECT page_id, html, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
"""
SQL = rf"""
WITH b AS ({_KEY}), h AS (
  SELECT page_id, html, regexp_extract(bare, '^([^/?]*)', 1) AS host0, bare FROM b
), p AS (
  SELECT page_id, html, md5(html) AS digest, length(html) AS n,
    regexp_replace(regexp_replace(lower(regexp_replace(host0, '^.*@', '')), ':(80|443)$', ''), '^www\.', '') AS host,
    substr(bare, length(host0) + 1) AS rest FROM h
), q AS (
  SELECT page_id, digest, n, host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') ||
    CASE WHEN regexp_extract(rest, '^[^?]*\?(.*)$', 1) <> ''
         THEN '?' || array_to_string(list_sort(string_split(regexp_extract(rest, '^[^?]*\?(.*)$', 1), '&')), '&') ELSE '' END AS url_key
  FROM p
), v AS (SELECT page_id * 2 + 1 AS record_id, url_key, digest AS etag, page_id + 500 AS seen FROM q),
m AS (
  SELECT v.record_id, v.url_key, v.etag, v.seen, r.page_id AS r_page, r.digest AS r_digest, r.n AS r_n,
    row_number() OVER (PARTITION BY v.record_id ORDER BY r.page_id DESC NULLS LAST) AS rn
  FROM v LEFT JOIN q r ON r.url_key = v.url_key AND r.page_id < v.seen
)
SELECT record_id, url_key,
  CASE WHEN r_page IS NULL THEN 'no_response' WHEN etag = r_digest THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN etag = r_digest THEN r_page * 2 END AS resolved_id,
  CASE WHEN etag = r_digest THEN 'content-type=text/html' || chr(10) || 'date=' || seen || chr(10) || 'etag=' || etag END AS headers,
  CASE WHEN etag = r_digest THEN r_digest END AS payload_digest,
  CASE WHEN etag = r_digest THEN r_n END AS payload_length
FROM m WHERE rn = 1
"""
