"""Not-modified revisits of a web archive, resolved to the latest earlier full response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorewell.llm.common import staged, table

#: Records that a range of time holds at most.
SPAN_RECORDS = 1_000_000
#: Headers that a 304 answer may change.
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "vary"]


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. or m. and default port, https for http, no fragment, no final slash. A URL without a
    scheme stays as it is but for its fragment."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[a-zA-Z]+://([^/?]*)", 1)), r"^(www|m)\.|:(80|443)$", "")
    rest = F.regexp_replace(F.regexp_extract(u, r"^[a-zA-Z]+://[^/?]*(.*)$", 1), "/$", "")
    return F.when(host == "", u).otherwise(F.concat(F.lit("https://"), host, rest))


def lower_names(headers: Column) -> Column:
    """A map of headers with lower-case names; of names that differ by case only the first one's value."""
    entries = F.map_entries(headers)
    names = F.array_distinct(F.transform(F.map_keys(headers), lambda k: F.lower(k)))
    value = lambda n: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == n), 0)["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def validators(etag: Column, modified: Column, their_etag: Column, their_modified: Column) -> Column:
    """'resolved', 'mismatch' or 'unchecked': by ETag where both have one (weak comparison: W/ doesn't count), else by
    Last-Modified where both have one."""
    plain = lambda tag: F.regexp_replace(tag, "^W/", "")
    same = F.when(etag.isNotNull() & their_etag.isNotNull(), plain(etag) == plain(their_etag)).when(modified.isNotNull() & their_modified.isNotNull(), modified == their_modified)
    return F.when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")


def dealt_by_time(records: DataFrame) -> DataFrame:
    """records with part: ranges of ts, of about equally many records and SPAN_RECORDS at most or so, as many as shuffle
    partitions at least, in order. Records of one time are told apart by a hash, so a time with a third of all records is
    many parts too. Written once."""
    parts = max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-records.count() // SPAN_RECORDS))
    return staged(records.repartitionByRange(parts, "ts", F.xxhash64("record_id", "etag", "last_modified")).withColumn("part", F.spark_partition_id()))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records: record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, headers (map). One row per
    revisit: record_id, canonical_url, response_id, status, headers.

    An as-of join: for each revisit the full response of the same canonical URL with the largest (ts, record_id) before
    its own ts. Records are dealt out by ranges of time; of each range a URL's last response and its last one of an earlier
    time are carried on, over three rows a range at most, so neither a URL nor a time with a third of all records is a
    single task. A revisit meets what its own range has before it, and what stands before that range begins, or at that very moment if the revisit comes later. status: see validators(); 'orphan' where
    nothing earlier stands; response_id and headers are null for a mismatch and an orphan. Headers are the response's with
    the permitted ones of the revisit over them, names in lower case. Revisits with a null URL or time are orphans and
    responses with one are never found; a revisit at the time of a response is not after it; repeated rows are returned
    each; an empty table gives no rows; other columns are not read.
    """
    none = F.expr("cast(map() as map<string,string>)")
    r = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "last_modified", lower_names(F.coalesce("headers", none)).alias("headers"))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    lost = r.filter(~usable & (F.col("kind") == "revisit")).select("record_id", "canonical_url", F.lit(None).cast(dict(r.dtypes)["record_id"]).alias("response_id"), F.lit("orphan").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    r = dealt_by_time(r.filter(usable))
    answer = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "last_modified", "headers"))
    when = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    each = r.filter("kind = 'response'").groupBy("canonical_url", "part", "ts").agg(F.max_by(answer, when).alias("answer"))
    latest = Window.partitionBy("canonical_url", "part").orderBy(F.desc("ts"))
    lasts = each.withColumn("n", F.row_number().over(latest)).filter("n <= 2").select("canonical_url", "ts", "answer", F.lit(None).cast("int").alias("part"))
    begins = r.groupBy("part").agg(F.min("ts").alias("ts"))
    asks = r.select("canonical_url", "part").distinct().join(begins, "part").select("canonical_url", "ts", F.lit(None).cast(dict(lasts.dtypes)["answer"]).alias("answer"), "part")
    line = Window.partitionBy("canonical_url").orderBy("ts")
    pick = lambda upto: F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct("answer.ts", "answer.record_id"))).over(line.rangeBetween(Window.unboundedPreceding, upto))
    carried = lasts.union(asks).select("*", pick(-1).alias("earlier"), pick(0).alias("by_then")).filter("part is not null")
    carried = carried.select("canonical_url", "part", F.col("ts").alias("begin"), "earlier", "by_then")
    inside = Window.partitionBy("canonical_url", "part").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("here", F.max_by(answer, when).over(inside)).filter("kind = 'revisit'").join(carried, ["canonical_url", "part"])
    before = F.when(F.col("ts") > F.col("begin"), F.col("by_then")).otherwise(F.col("earlier"))
    later = F.col("here.ts").isNotNull() & (before["ts"].isNull() | (F.struct("here.ts", "here.record_id") > F.struct(before["ts"], before["record_id"])))
    r = r.withColumn("found", F.when(later, F.col("here")).otherwise(before))
    status = F.when(F.col("found").isNull(), "orphan").otherwise(validators(F.col("etag"), F.col("last_modified"), F.col("found.etag"), F.col("found.last_modified")))
    own = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    merged = F.map_concat(F.map_filter(F.col("found.headers"), lambda k, _: ~F.map_contains_key(own, k)), own)
    ok = F.col("status").isin("resolved", "unchecked")
    out = r.withColumn("status", status)
    return out.select("record_id", "canonical_url", F.when(ok, F.col("found.record_id")).alias("response_id"), "status", F.when(ok, merged).alias("headers")).union(lost)


def archive_of(pages: DataFrame) -> DataFrame:
    """An archive made of the pages table. A third of the pages share one URL, a third share a URL by twelves, the others
    keep their own. Each page gives a full response (every fifth doesn't) and a revisit, at times that run through all of
    the archive's span, so the response that a revisit finds is mostly another page's, one of many before it or none.
    Tags are strong, weak, missing or of the page's content; some have a date of change; some times and URLs are null."""
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.md5(F.coalesce("html", F.lit("")).cast("binary")).alias("sum"))
    twelve = F.concat(F.lit("https://www.Site.example/p/"), F.floor(F.col("id") / 12).cast("string"), F.lit("/"))
    p = p.withColumn("at", F.when(F.col("id") % 3 == 0, "http://hot.example:80/").when(F.col("id") % 3 == 1, twelve).otherwise(F.col("url")))
    header = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.cast("string").alias("value")))
    headers = lambda *h: F.map_from_entries(F.filter(F.array(*h), lambda e: e.isNotNull()))
    id_, number = F.col("id"), lambda n: (F.col("id") % n).cast("string")
    ts = (id_ * 7919) % 1_000_003
    etag = F.when(id_ % 4 == 0, F.lit(None)).when(id_ % 4 == 3, F.col("sum")).otherwise(F.concat(F.lit('"v'), number(2), F.lit('"')))
    day = F.when(id_ % 4 != 2, F.concat(F.lit("day "), (F.floor(id_ / 7) % 2).cast("string")))
    full = p.filter("id % 5 <> 0").select((id_ * 2).alias("record_id"), F.col("at").alias("url"), ts.alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), day.alias("last_modified"),
                                          headers(header("Content-Type", F.lit("text/html")), header("ETag", etag), header("Date", ts), header("X-Sum", F.col("sum"))).alias("headers"))
    later = F.when(id_ % 97 != 0, (id_ * 104_729 + 13) % 1_000_003)
    seen = F.when(id_ % 5 == 0, F.lit(None)).when(id_ % 5 == 3, F.lit('W/"v1"')).when(id_ % 5 == 4, F.col("sum")).otherwise(F.concat(F.lit('"v'), (id_ % 5 - 1).cast("string"), F.lit('"')))
    again = p.select((id_ * 2 + 1).alias("record_id"), F.when(id_ % 101 != 0, F.concat("at", F.lit("#again"))).alias("url"), later.alias("ts"), F.lit("revisit").alias("kind"), seen.alias("etag"),
                     F.concat(F.lit("day "), number(2)).alias("last_modified"), headers(header("date", later), header("CACHE-CONTROL", number(10)), header("content-length", F.lit("0"))).alias("headers"))
    return full.union(again)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(staged(archive_of(table(spark, sf_dir, "pages").select("page_id", "url", "html"))))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select("record_id", "canonical_url", "response_id", "status", flat.alias("headers"))


OP7_SQL = r"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS id, md5(coalesce(html, '')) AS digest,
  CASE CAST(page_id AS BIGINT) % 3 WHEN 0 THEN 'http://hot.example:80/' WHEN 1 THEN 'https://www.Site.example/p/' || (CAST(page_id AS BIGINT) // 12) || '/' ELSE url END AS addr FROM pages),
u AS (SELECT *, regexp_replace(trim(addr), '#.*$', '') AS u FROM p),
c AS (SELECT id, digest, CASE WHEN regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1) = '' THEN u ELSE 'https://' || regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?]*)', 1)), '^(www|m)\.|:(80|443)$', '', 'g')
         || regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]*(.*)$', 1), '/$', '') END AS cu FROM u),
full_ AS (SELECT id * 2 AS response_id, cu, (id * 7919) % 1000003 AS ts, digest,
  CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 3 THEN digest ELSE '"v' || (id % 2) || '"' END AS etag, CASE WHEN id % 4 <> 2 THEN 'day ' || (id // 7 % 2) END AS day FROM c WHERE id % 5 <> 0 AND cu IS NOT NULL),
last_ AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY cu, ts ORDER BY response_id DESC) = 1),
again AS (SELECT id, id * 2 + 1 AS record_id, CASE WHEN id % 101 <> 0 THEN cu END AS cu, CASE WHEN id % 97 <> 0 THEN (id * 104729 + 13) % 1000003 END AS ts,
  CASE id % 5 WHEN 0 THEN NULL WHEN 3 THEN 'W/"v1"' WHEN 4 THEN digest ELSE '"v' || (id % 5 - 1) || '"' END AS etag, 'day ' || (id % 2) AS day FROM c),
met AS (SELECT a.*, l.response_id, l.etag AS etag2, l.day AS day2, l.digest AS digest2 FROM again a ASOF LEFT JOIN last_ l ON a.cu = l.cu AND a.ts > l.ts),
s AS (SELECT *, CASE WHEN response_id IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND etag2 IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(etag2, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
  WHEN day IS NOT NULL AND day2 IS NOT NULL THEN CASE WHEN day = day2 THEN 'resolved' ELSE 'mismatch' END ELSE 'unchecked' END AS status FROM met)
SELECT record_id, cu AS canonical_url, CASE WHEN status IN ('resolved', 'unchecked') THEN response_id END AS response_id, status,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'cache-control=' || (id % 10) || ';content-type=text/html;date=' || ts || coalesce(';etag=' || etag2, '') || ';x-sum=' || digest2 END AS headers FROM s
"""
