"""Resolution of not-modified revisit records: an as-of join by canonical URL.

A revisit (a 304 answer) stands for the latest earlier full response of its canonical URL. If its
validators agree with that response, the response's body is its body and the headers that a 304 may update
are merged over the stored ones. All revisits of a URL at one instant have the same answer, so instants are joined first:
within short buckets of time, and over one row for each URL and bucket. A group is thus the different instants of
one bucket or the buckets of one URL, however many records there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylens.llm.common import read, written

# Headers that a 304 response may update in a stored response, and default ports.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
DEFAULT_PORTS = {"http": "80", "https": "443"}
#: Revisits that one copy of a response's body serves, and the responses with more copies that are broadcast (12 bytes each).
REVISITS_OF_COPY = 1000
HOT_RESPONSES = 200_000


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment dropped, an empty path as /, query
    parameters sorted and without empty ones. A text that is no absolute URL stays as it is; null stays null."""
    part = lambda k: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", k)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    for name, port in DEFAULT_PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.array_join(F.array_sort(F.array_remove(F.split(F.substr(part(4), F.lit(2)), "&"), "")), "&")
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def resolve_revisits(records: DataFrame, bucket_seconds: int = 3600, with_body: bool = True) -> DataFrame:
    """One row per revisit record: its record_id, url, canonical_url, warc_date, outcome, response_id,
    headers, payload_digest and, if asked for, body.

    ``records``: record_id long, url string, warc_type string, warc_date timestamp, status int, headers
    map<string,string> with lower-case names, payload_digest string, body string. Full responses are of
    type response with status 200. Revisits at the instant of a response do not see it; of responses at one
    instant the larger record_id counts as later. Outcomes: ``resolved``; ``mismatch`` (an entity tag, or
    else a modification date, that differs from the response's or that it lacks); ``missing`` (no earlier
    response, or a null URL or date). Only resolved rows have a response_id, merged headers and a body; the
    others keep their own headers. Tags compare weakly (a leading W/ is ignored). A revisit without
    validators is resolved. Repeated rows are resolved alike; of responses with one URL, record_id and instant the
    smallest body counts. Other columns, whatever they are called, are not read; an empty table gives no rows.
    """
    full = (F.col("warc_type") == "response") & (F.col("status") == 200)
    own = records.select(
        "record_id", "url", canonical_url(F.col("url")).alias("canonical_url"), "warc_date", "headers",
        F.coalesce(full, F.lit(False)).alias("is_full"), F.coalesce(F.col("warc_type") == "revisit", F.lit(False)).alias("is_revisit"),
        F.when(full, F.struct("warc_date", "record_id", "headers", "payload_digest")).alias("response"),
        F.floor(F.unix_timestamp(F.col("warc_date").cast("timestamp")) / bucket_seconds).alias("bucket"),
    ).where("is_full OR is_revisit")
    placed = own.where(F.col("canonical_url").isNotNull() & F.col("warc_date").isNotNull())
    keys = ["canonical_url", "bucket"]
    later = F.when(F.col("is_full"), F.struct(F.col("record_id").isNotNull().alias("known"), "record_id"))  # maps are not compared
    instants = placed.groupBy(*keys, "warc_date").agg(F.max_by("response", later).alias("response"), F.max("is_revisit").alias("asks"))
    local = Window.partitionBy(*keys).orderBy("warc_date").rowsBetween(Window.unboundedPreceding, -1)
    seen = instants.withColumn("near", F.last("response", ignorenulls=True).over(local))
    latest = instants.groupBy(*keys).agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.col("warc_date"))).alias("response"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select(*keys, F.last("response", ignorenulls=True).over(before).alias("far"))
    answers = seen.where("asks").drop("response").join(carried, keys, "left").select("canonical_url", "warc_date", F.coalesce("near", "far").alias("of"))
    # written, so that both sides of the join below have plain exchanges and an instant with very many revisits can be split
    found = placed.where("is_revisit").drop("response", "is_full").join(written(answers, "answers"), ["canonical_url", "warc_date"], "left")
    lost = own.where("is_revisit AND (canonical_url IS NULL OR warc_date IS NULL)").drop("response", "is_full").withColumn("of", F.lit(None).cast(found.schema["of"].dataType))
    columns = ["record_id", "url", "canonical_url", "warc_date", "headers", "of"]
    found = found.select(*columns).unionByName(lost.select(*columns))
    tag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    mine, theirs = F.col("headers"), F.col("of.headers")
    same = F.when(mine["etag"].isNotNull(), tag(mine).eqNullSafe(tag(theirs))).when(mine["last-modified"].isNotNull(), mine["last-modified"].eqNullSafe(theirs["last-modified"])).otherwise(True)
    outcome = F.when(F.col("of").isNull(), "missing").when(same, "resolved").otherwise("mismatch")
    found = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    fresh = F.map_filter(F.coalesce(mine, F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*PERMITTED))
    kept = F.map_filter(F.coalesce(theirs, F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    out = found.select(
        "record_id", "url", "canonical_url", "warc_date", "outcome", F.when(resolved, F.col("of.record_id")).alias("response_id"),
        F.when(resolved, F.map_concat(kept, fresh)).otherwise(mine).alias("headers"), F.when(resolved, F.col("of.payload_digest")).alias("payload_digest"), F.when(resolved, F.col("of.warc_date")).alias("response_date"),
    )
    if not with_body:
        return out.drop("response_date")
    out = written(out, "resolved")
    hot = out.where("response_id IS NOT NULL").groupBy("response_id").count().where(F.col("count") > REVISITS_OF_COPY)
    hot = written(hot.select("response_id", F.ceil(F.col("count") / REVISITS_OF_COPY).cast("int").alias("copies")), "hot-responses")
    hot = F.broadcast(hot) if hot.count() <= HOT_RESPONSES else hot
    copies = F.coalesce("copies", F.lit(1))
    bodies = records.where(full).groupBy(F.col("record_id").alias("response_id"), F.col("warc_date").alias("response_date"), canonical_url(F.col("url")).alias("canonical_url")).agg(F.min("body").alias("body"))
    bodies = bodies.join(hot, "response_id", "left").select("response_id", "response_date", "canonical_url", F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"), "body")
    dealt = out.join(hot, "response_id", "left").withColumn("copy", F.pmod(F.xxhash64("record_id", "url", "warc_date"), copies).cast("int"))
    return dealt.join(bodies, ["response_id", "response_date", "canonical_url", "copy"], "left").select(*[c for c in out.columns if c != "response_date"], "body")


def crawl_records(pages: DataFrame) -> DataFrame:
    """Records of a crawl that follows from ``pages``: each page is a response at an instant given by its
    page_id, and is asked for again some days later and answered 304; of these answers
    some carry an entity tag that the page never had, some only a date, some no validator."""
    t0 = F.lit("2024-01-01 00:00:00").cast("timestamp")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.md5("html")
    day = F.date_format(F.timestamp_seconds(F.unix_timestamp(t0) + F.col("page_id") * 37), "yyyy-MM-dd'T'HH:mm:ss")
    responses = base.select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.lit("response").alias("warc_type"),
        F.timestamp_seconds(F.unix_timestamp(t0) + F.col("page_id") * 37).alias("warc_date"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), digest, F.lit("last-modified"), day, F.lit("content-length"), F.octet_length("html").cast("string")).alias("headers"),
        digest.alias("payload_digest"), F.col("html").alias("body"),
    )
    kind = F.pmod("page_id", F.lit(12))
    validators = (
        F.when(kind == 0, F.create_map(F.lit("etag"), F.lit("none"), F.lit("date"), day))
        .when(kind == 3, F.create_map(F.lit("last-modified"), day, F.lit("content-length"), F.lit("0")))
        .when(kind == 6, F.create_map(F.lit("date"), day))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), digest), F.lit("date"), day))
    )
    revisits = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", F.lit("revisit").alias("warc_type"),
        F.timestamp_seconds(F.unix_timestamp(t0) + F.col("page_id") * 37 + 172800).alias("warc_date"), F.lit(304).alias("status"),
        validators.alias("headers"), F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("string").alias("body"),
    )
    return responses.unionByName(revisits)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """A revisit for every page, resolved. Null URLs are missing, null html is an empty body, pages that repeat an id are records
    of their own; a very long body is joined whole; an empty table gives no rows; other columns are not read."""
    out = resolve_revisits(crawl_records(read(spark, sf_dir, "pages")))
    # the digest is of the body that was joined, not the one that the response's record names
    return out.select("record_id", "canonical_url", "outcome", "response_id", F.col("headers")["etag"].alias("etag"), F.size("headers").cast("long").alias("n_headers"), F.md5("body").alias("payload_digest"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 1)) AS scheme,
         lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 2)) AS host0,
         regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 3) AS path,
         array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4), 2), '&'), lambda x: x <> '')), '&') AS query,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id * 37) AS t
  FROM pages),
c AS (
  SELECT *, CASE WHEN scheme = '' THEN url ELSE scheme || '://'
      || CASE WHEN scheme = 'http' THEN regexp_replace(host0, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host0, ':443$', '') ELSE host0 END
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical_url
  FROM p),
r AS (SELECT *, t + INTERVAL 2 DAY AS asked, page_id % 12 AS kind FROM c),
j AS (
  SELECT r.page_id, r.canonical_url, r.kind, r.digest, r.t, f.page_id AS of_id, f.digest AS of_digest, f.t AS of_t,
         row_number() OVER (PARTITION BY r.page_id ORDER BY f.t DESC, f.page_id DESC) AS k
  FROM r LEFT JOIN c f ON f.canonical_url = r.canonical_url AND f.t < r.asked),
o AS (
  SELECT *, CASE WHEN of_id IS NULL THEN 'missing'
      WHEN kind = 0 THEN 'mismatch' WHEN kind = 3 THEN CASE WHEN t = of_t THEN 'resolved' ELSE 'mismatch' END
      WHEN kind = 6 THEN 'resolved' WHEN digest = of_digest THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM j WHERE k = 1)
SELECT page_id * 2 + 1 AS record_id, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN of_id * 2 END AS response_id,
       CASE WHEN outcome = 'resolved' THEN CASE WHEN kind IN (3, 6) THEN of_digest ELSE 'W/' || digest END
            WHEN kind = 0 THEN 'none' WHEN kind IN (3, 6) THEN NULL ELSE 'W/' || digest END AS etag,
       CAST(CASE WHEN outcome = 'resolved' THEN CASE WHEN kind = 3 THEN 3 ELSE 4 END ELSE CASE WHEN kind = 6 THEN 1 ELSE 2 END END AS BIGINT) AS n_headers,
       CASE WHEN outcome = 'resolved' THEN of_digest END AS payload_digest
FROM o
"""
