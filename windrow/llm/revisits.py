"""WARC not-modified revisits: as-of join to the latest earlier full response.

Records are cut into time buckets by range partitioning on (time, id), so a
bucket is bounded whatever the clock and whichever URL dominates.  Within a
bucket a window looks back over one URL's records; across buckets the last
full response of every (URL, bucket), a partially aggregated maximum, is
carried forward.  A URL with a third of all records thus never meets in one
task.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrow.llm.shared import stored, table

#: Records aimed at in a time bucket.
PER_BUCKET = 1_000_000
#: Header fields that a 304 response may update, after the HTTP caching rules.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content.
TRACKING = "utm_[^=]*|ref|fbclid|gclid|sessionid"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(url: Column) -> Column:
    """URL without scheme, user, default port, ``www.``, fragment, trailing slash and tracking parameters; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#[\s\S]*$", "")
    where = F.translate(F.regexp_extract(bare, r"^[^/?]*", 0), _UPPER, _LOWER)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(where, r"^[\s\S]*@", ""), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?([\s\S]*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&", -1), lambda x: (x != "") & ~F.rlike(x, F.lit(f"^({TRACKING})(=|$)"))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(base: Column, update: Column) -> Column:
    """Header map of the full response with the permitted fields of the revisit put over it."""
    allowed = F.map_filter(update, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(allowed), k), F.lit(False))), allowed)


def resolved(records: DataFrame) -> DataFrame:
    """Resolve ``records(record_id, url, ts, is_full, headers, digest)``.

    Adds ``canonical_url, outcome, resolved_to, merged, body_digest`` to
    record_id; one row per input row.  ``headers`` has lower-case names.

    A full response is ``full`` and stands for itself.  A revisit goes to the
    latest full response of its canonical URL that is earlier by (ts,
    record_id).  It is ``resolved`` if the validators agree: the entity tag by
    weak comparison where the revisit has one, else Last-Modified, else the
    digest; ``mismatch`` if they differ or it has none; ``orphan`` if there is
    no such response, or the URL or time is null.  Only resolved revisits have
    merged headers and a body digest.  A null ``is_full`` counts as a revisit,
    a null header map as empty; other columns are not read.
    """
    spark = records.sparkSession
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    r = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), F.coalesce("is_full", F.lit(False)).alias("is_full"), headers.alias("headers"), "digest")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), r.count() // PER_BUCKET + 1)
    cut = stored(r.repartitionByRange(parts, "ts", "record_id").withColumn("bucket", F.spark_partition_id()), "records")
    ok = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    body = F.struct("ts", "record_id", F.map_entries("headers").alias("headers"), "digest")
    key = ["canonical_url", "bucket"]
    full_key = F.when(F.col("is_full") & ok, F.struct("ts", "record_id"))
    last = cut.groupBy(*key).agg(F.max(full_key).alias("last"))
    before = Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("carried is not null").drop("last")
    # the carried key is a pair of numbers; the response it names is fetched by an equi-join
    # of equal (ts, record_id) revisits come first, so that no full response of their own key is before them; equal keys share a range partition
    inside = Window.partitionBy(*key).orderBy("ts", "record_id", "is_full").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last(F.when(F.col("is_full") & ok, F.struct("ts", "record_id")), ignorenulls=True).over(inside))
    aimed = near.join(carried, key, "left").withColumn("aim", F.when(~F.col("is_full") & ok, F.coalesce("near", "carried")))
    aimed = aimed.select("record_id", "canonical_url", "is_full", "headers", "digest", F.col("aim.ts").alias("a_ts"), F.col("aim.record_id").alias("a_id"))
    fulls = cut.where(F.col("is_full") & ok).groupBy(F.col("canonical_url").alias("f_url"), F.col("ts").alias("f_ts"), F.col("record_id").alias("f_id")).agg(F.min_by(body, F.coalesce("digest", F.lit(""))).alias("full"))
    both = aimed.join(fulls, (F.col("canonical_url") == F.col("f_url")) & (F.col("a_ts") == F.col("f_ts")) & (F.col("a_id") == F.col("f_id")), "left")
    base = F.map_from_entries("full.headers")
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    agree = F.when(etag.isNotNull(), _weak(etag) == _weak(base["etag"])).when(modified.isNotNull(), modified == base["last-modified"]).otherwise(F.col("digest") == F.col("full.digest"))
    outcome = F.when(F.col("is_full"), "full").when(F.col("full").isNull(), "orphan").when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("mismatch")
    done = both.withColumn("outcome", outcome).withColumn("base", base)
    good = F.col("outcome") == "resolved"
    return done.select(
        "record_id",
        "canonical_url",
        "outcome",
        F.when(good, F.col("full.record_id")).alias("resolved_to"),
        F.when(good, merged_headers(F.col("base"), F.col("headers"))).when(F.col("is_full"), F.col("headers")).alias("merged"),
        F.when(good, F.col("full.digest")).when(F.col("is_full"), F.col("digest")).alias("body_digest"),
    )


def with_bodies(done: DataFrame, bodies: DataFrame) -> DataFrame:
    """Attach ``body`` of ``bodies(record_id, body)``: a full record's own, a resolved revisit's from the response it stands for."""
    source = F.coalesce("resolved_to", F.when(F.col("outcome") == "full", F.col("record_id")))
    b = bodies.select(F.col("record_id").alias("_body_id"), "body")
    return done.join(b, source == F.col("_body_id"), "left").drop("_body_id")


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records of raw pages, ordered in time by page_id.

    A page fetched under a plain URL is a full response; one whose URL has a
    query or fragment is a re-fetch that was answered "not modified".  The
    entity tag is a weak one, by the size class of the page.
    """
    tag = F.concat(F.lit('W/"'), F.floor(F.length("html") / 4096).cast("string"), F.lit('"'))
    full = ~F.rlike(F.coalesce("url", F.lit("")), F.lit("[?#]"))
    date = F.concat(F.lit("day-"), F.floor(F.col("page_id") / 1000).cast("string"))
    update = F.create_map(F.lit("etag"), tag, F.lit("date"), date, F.lit("content-length"), F.lit("0"))
    whole = F.create_map(F.lit("etag"), tag, F.lit("date"), date, F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.length("html").cast("string"))
    return pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("ts"), full.alias("is_full"), F.when(full, whole).otherwise(update).alias("headers"), F.md5(F.col("html").cast("binary")).alias("digest"))


def op6_revisits(spark, sf_dir: str) -> DataFrame:
    """Every page's capture record resolved."""
    done = resolved(records_of(table(spark, sf_dir, "pages")))
    heads = F.array_join(F.array_sort(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return done.select(F.col("record_id").alias("page_id"), "canonical_url", "outcome", F.col("resolved_to"), heads.alias("headers"), "body_digest")


#: DuckDB SQL for op6_revisits' rows.
OP6_SQL = rf"""
WITH bare AS (
  SELECT page_id, url, html, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#[\s\S]*$', '') AS b FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(translate(regexp_extract(b, '^[^/?]*', 0), '{_UPPER}', '{_LOWER}'), '^[\s\S]*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?([\s\S]*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({TRACKING})(=|$)'))) AS q FROM bare),
rec AS (
  SELECT page_id, host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c, NOT regexp_matches(coalesce(url, ''), '[?#]') AS is_full,
         'W/"' || CAST(length(html) // 4096 AS VARCHAR) || '"' AS etag, 'day-' || CAST(page_id // 1000 AS VARCHAR) AS date, length(html) AS n, md5(html) AS digest FROM parts),
f AS (SELECT * FROM rec WHERE is_full),
aimed AS (SELECT r.*, f.page_id AS f_id, f.etag AS f_etag, f.n AS f_n, f.digest AS f_digest FROM rec r ASOF LEFT JOIN f ON r.c = f.c AND r.page_id > f.page_id),
done AS (SELECT *, CASE WHEN is_full THEN 'full' WHEN f_id IS NULL THEN 'orphan' WHEN etag = f_etag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM aimed)
SELECT page_id, c AS canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN f_id END AS resolved_to,
       CASE WHEN outcome = 'resolved' THEN 'content-length=' || f_n || ';content-type=text/html;date=' || date || ';etag=' || etag
            WHEN outcome = 'full' THEN 'content-length=' || n || ';content-type=text/html;date=' || date || ';etag=' || etag END AS headers,
       CASE WHEN outcome = 'resolved' THEN f_digest WHEN outcome = 'full' THEN digest END AS body_digest
FROM done
"""
