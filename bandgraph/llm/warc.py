"""Not-modified revisits of WARC captures: as-of resolution to the response they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bandgraph.llm.common import own_names, quoted
from bandgraph.session import cut, table

#: Headers of a 304 response that replace those of the stored response (RFC 9110 15.4.5, RFC 9111 3.2).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't tell pages apart.
IGNORED = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"
#: Ranges of capture time; a URL's captures are looked through range by range, so none is one task's alone.
RANGES = 128


def canonical(url: Column) -> Column:
    """URL without scheme, user, www, default port, fragment, tracking parameters and trailing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^[^@]*@", ""), r"^www[0-9]*\.", "")
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(IGNORED)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """A header map with names in lower case; of names that then are equal the first stays."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.get(F.filter(entries, lambda e: F.lower(e["key"]) == k), F.lit(0))["value"]))


def _sources(slim: DataFrame) -> DataFrame:
    """(curl, date, source): for each URL and time of slim (curl, date, rid) the latest rid before it.

    Captures of one URL and time count as one, combined before the shuffle. Times are cut into RANGES by quantiles; a
    window looks back within a URL's range, and one over the ranges' last responses (RANGES rows at most for a URL) brings
    forward what earlier ranges have.
    """
    slim = cut(slim.groupBy("curl", "date").agg(F.max("rid").alias("rid")))
    share = [k / RANGES for k in range(1, RANGES)]
    bounds = slim.agg(F.percentile_approx(F.unix_micros("date"), share, 10_000).alias("bounds"))  # one row
    slim = slim.join(F.broadcast(bounds)).withColumn("range", F.size(F.filter("bounds", lambda b: b <= F.unix_micros("date")))).drop("bounds")
    before = (Window.unboundedPreceding, -1)
    inside = F.last("rid", ignorenulls=True).over(Window.partitionBy("curl", "range").orderBy("date").rowsBetween(*before))
    per = slim.where("rid IS NOT NULL").groupBy("curl", "range").agg(F.max_by("rid", "date").alias("rid"))
    ranges = slim.select("curl", "range").distinct().join(per, ["curl", "range"], "left")
    carried = F.last("rid", ignorenulls=True).over(Window.partitionBy("curl").orderBy("range").rowsBetween(*before))
    ranges = ranges.select("curl", "range", carried.alias("carried"))
    return slim.withColumn("inside", inside).join(ranges, ["curl", "range"]).select("curl", "date", F.coalesce("inside", "carried").alias("source"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit of records (record_id, url, date, kind, status, headers map, digest) with what it stands for.

    kind is 'response' or 'revisit'; a full response has status 200. A revisit stands for the latest full response of its
    canonical URL with an earlier date (of equal dates the greatest record_id). Validators decide on `result`: ETags (weak
    comparison) if both have one, else Last-Modified, else digests; 'resolved' if equal, 'changed' if not, 'unverified' if
    nothing can be compared, 'missing' without such a response. Added: canonical_url, source_id (null unless resolved),
    result, merged_headers (the response's, with permitted ones of the revisit instead; null unless resolved), and each other
    column x of records, as source_x, of the response (its payload, say).

    A null date, URL or record_id matches nothing: 'missing'. Repeated revisits get equal rows each; repeated record_ids of
    responses count as one, with the greatest digest. Header names are compared in lower case. An empty table gives no rows.
    Columns of records of the added names are replaced; columns id and headers of a response have no source_ copy.
    """
    extra = [c for c in records.columns if c.lower() not in ("record_id", "url", "date", "kind", "status", "headers")]
    copied = {f"source_{c}": c for c in extra if c.lower() not in ("id", "headers")}
    added = {n.lower() for n in ("canonical_url", "result", "source_id", "merged_headers", *copied)}
    url, r_url, r_at, r_id, rid, r = own_names(records, "c_url", "r_url", "r_at", "r_id", "rid", "r")
    all_ = records.withColumn(url, canonical(F.col("url"))).withColumn("headers", lower_names(F.col("headers")))
    full = all_.where((F.col("kind") == "response") & (F.col("status") == 200) & F.col("record_id").isNotNull())
    revisits = all_.where(F.col("kind") == "revisit")
    keyed = lambda df, rid: df.where(F.col(url).isNotNull() & F.col("date").isNotNull()).select(F.col(url).alias("curl"), "date", rid.cast("string").alias("rid"))
    found = _sources(keyed(full, F.col("record_id")).union(keyed(revisits, F.lit(None))))
    found = found.where("source IS NOT NULL").select(F.col("curl").alias(r_url), F.col("date").alias(r_at), F.col("source").alias(r_id))
    out = revisits.join(found, (F.col(url) == F.col(r_url)) & (F.col("date") == F.col(r_at)), "left")
    whole = F.struct(F.col("headers").alias("headers"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(copied.values())))
    response = full.groupBy(F.col("record_id").cast("string").alias(rid)).agg(F.max_by(whole, F.coalesce("digest", F.lit(""))).alias(r))
    # Revisits without a source have keys of their own, or one task would get them all.
    key = F.coalesce(r_id, F.concat(F.lit("\0"), F.coalesce(F.col("record_id").cast("string"), F.xxhash64("url", "date").cast("string"))))
    out = out.join(response, key == F.col(rid), "left")
    theirs = lambda c: F.col(r)[c]
    tag = lambda h: F.regexp_replace(F.trim(F.element_at(h, "etag")), "^W/", "")
    modified = lambda h: F.trim(F.element_at(h, "last-modified"))
    same = lambda f, g: F.when(f.isNotNull() & g.isNotNull(), f == g)
    digest = theirs(f"c{list(copied.values()).index('digest')}")
    equal = F.coalesce(same(tag(F.col("headers")), tag(theirs("headers"))), same(modified(F.col("headers")), modified(theirs("headers"))), same(F.col("digest"), digest))
    result = F.when(F.col(r_id).isNull(), "missing").when(equal.isNull(), "unverified").when(equal, "resolved").otherwise("changed")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter(theirs("headers"), lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    own = [quoted(c) for c in records.columns if c.lower() not in added]
    done = out.select(*own, F.col(url).alias("canonical_url"), result.alias("result"), *(theirs(f"c{i}").alias(n) for i, n in enumerate(copied)), F.col(r_id).alias(rid), merged.alias(r))
    ok = F.col("result") == "resolved"
    return done.withColumn("merged_headers", F.when(ok, F.col(r))).withColumn("source_id", F.when(ok, F.col(rid))).drop(r, rid)


def capture_log(pages: DataFrame) -> DataFrame:
    """A capture log of pages (page_id, url, html): a full response of each, and a later not-modified revisit.

    Page p is fetched at minute p, and revisited by another spelling of its URL (host in capitals, a fragment) after
    p % 97 minutes more, or, for every 11th, 5 minutes before its fetch. ETag and Last-Modified follow the content and the
    time of fetch; every 7th revisit has another ETag, every 5th none.
    """
    p = F.col("page_id")
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000) + minutes * 60)
    etag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    modified = F.concat(F.lit("minute "), p.cast("string"))
    digest = F.sha2("html", 256)
    size = F.length("html").cast("bigint").alias("size")
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), etag, F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.lit("max-age=60"))
    response = pages.select(F.concat(F.lit("r"), p.cast("string")).alias("record_id"), "page_id", "url", at(p).alias("date"), F.lit("response").alias("kind"), F.lit(200).alias("status"), first.alias("headers"), digest.alias("digest"), size)
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "^https?://(www[.])?", "HTTPS://WWW."), "#.*$", ""), F.lit("#again"))
    seen = F.when(p % 7 == 0, F.concat(F.lit('"x'), F.substring(F.md5("html"), 1, 8), F.lit('"'))).when(p % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("W/"), etag))
    base = F.create_map(F.lit("Content-Type"), F.lit("message/http"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (p % 1000).cast("string")), F.lit("Date"), F.concat(F.lit("minute "), (p + p % 97).cast("string")), F.lit("Last-Modified"), modified)
    second = F.map_filter(F.map_concat(base, F.create_map(F.lit("ETag"), seen)), lambda _, v: v.isNotNull())
    when = F.when(p % 11 == 0, p - 5).otherwise(p + p % 97)
    revisit = pages.select(F.concat(F.lit("v"), p.cast("string")).alias("record_id"), "page_id", other.alias("url"), at(when).alias("date"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), second.alias("headers"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("size"))
    return response.union(revisit)


def op1_warc_revisits(spark, sf_dir: str) -> DataFrame:
    out = resolve_revisits(capture_log(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "|")
    return out.select("record_id", "page_id", "canonical_url", "result", "source_id", lines.alias("headers"), F.when(F.col("result") == "resolved", F.col("source_digest")).alias("digest"), F.when(F.col("result") == "resolved", F.col("source_size")).alias("size"))


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, md5(html) AS m, sha256(html) AS digest, CAST(length(html) AS BIGINT) AS size FROM pages
), rec AS (
  SELECT 'r' || page_id AS record_id, page_id, url, page_id AS mins, 'response' AS kind, '"' || left(m, 16) || '"' AS etag, digest, size FROM p
  UNION ALL
  SELECT 'v' || page_id, page_id, regexp_replace(regexp_replace(url, '^https?://(www[.])?', 'HTTPS://WWW.'), '#.*$', '') || '#again',
    CASE WHEN page_id % 11 = 0 THEN page_id - 5 ELSE page_id + page_id % 97 END, 'revisit',
    CASE WHEN page_id % 7 = 0 THEN '"x' || left(m, 8) || '"' WHEN page_id % 5 = 0 THEN NULL ELSE '"' || left(m, 16) || '"' END, NULL, NULL FROM p
), b AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\-]*://', '') AS bare FROM rec
), c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@', ''), '^www[0-9]*\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS hp,
    list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))) AS q FROM b
), k AS (
  SELECT *, hp || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical_url FROM c
), r AS (SELECT canonical_url AS curl, mins AS r_at, max(record_id) AS rid FROM k WHERE kind = 'response' GROUP BY 1, 2),
v AS (
  SELECT k.*, r.rid FROM (SELECT * FROM k WHERE kind = 'revisit') k LEFT JOIN r ON r.curl = k.canonical_url AND r.r_at < k.mins
  QUALIFY row_number() OVER (PARTITION BY k.record_id ORDER BY r.r_at DESC NULLS LAST) = 1
), j AS (
  SELECT v.*, s.etag AS s_etag, s.digest AS s_digest, s.size AS s_size, s.page_id AS s_page, CASE WHEN v.rid IS NULL THEN 'missing'
    WHEN v.etag IS NOT NULL THEN CASE WHEN v.etag = s.etag THEN 'resolved' ELSE 'changed' END
    WHEN v.page_id = s.page_id THEN 'resolved' ELSE 'changed' END AS result
  FROM v LEFT JOIN (SELECT * FROM k WHERE kind = 'response') s ON s.record_id = v.rid
)
SELECT record_id, page_id, canonical_url, result, CASE WHEN result = 'resolved' THEN rid END AS source_id,
  CASE WHEN result = 'resolved' THEN array_to_string(list_sort(['cache-control: max-age=' || page_id % 1000, 'content-type: text/html',
    'date: minute ' || (page_id + page_id % 97), 'etag: ' || coalesce('W/' || etag, s_etag), 'last-modified: minute ' || page_id]), '|') END AS headers,
  CASE WHEN result = 'resolved' THEN s_digest END AS digest, CASE WHEN result = 'resolved' THEN s_size END AS size
FROM j
"""
