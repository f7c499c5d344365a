"""WARC: not-modified revisits, resolved to the full response they stand for.

Records are rows (record_id, kind 'response' or 'revisit', url, time, etag, last_modified, digest,
headers map<string,string>). A revisit takes the latest full response of the same canonical URL
that is strictly earlier (the one with the larger record_id among equally late ones). Validators
then decide: a digest, an entity tag (weak comparison) or else a date of modification that both
have must be equal; with none in common the revisit is unverified. Headers of the revisit replace those of the
response, save the ones that describe its body or the connection.

One URL may hold a third of all rows, and one time too. Rows of one URL and time are one row at first (its latest response, combined before
the shuffle). Time is cut into spans of about equally many of these, each
(URL, span) keeps its latest response, a running maximum over spans carries it
on, and within a span only that span's times are sorted together: the number of spans grows with the input. Revisits
meet their URL's times by a join in which a hot (URL, time) is broadcast.

Rows with a null url or time match nothing ('no_response'); null headers are none; repeated
rows are resolved each; values of header names that differ in case alone are joined by commas (RFC 9110, 5.3) in the order of these names, null ones left out; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.components import joined
from causeway.runtime import settled

# fixed values: headers that a not-modified answer must not replace (RFC 9110, RFC 9111 3.2)
FORBIDDEN = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade"]
TRACKING = "(utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Scheme, user, port 80 or 443, leading www, fragment, tracking parameters, index pages and a last slash go; the host is in lower case, parameters are sorted."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    out = F.regexp_replace(out, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, rest = F.lower(F.regexp_extract(out, "^([^/?]*)", 1)), F.regexp_extract(out, "^[^/?]*(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path, query = F.regexp_extract(rest, "^([^?]*)", 1), F.regexp_extract(rest, "^[^?]*[?](.*)$", 1)
    path = F.regexp_replace(F.regexp_replace(path, "/index[.](html?|php)$", "/"), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)"))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def canonical_url_sql(url: str) -> str:
    """The same in DuckDB's SQL."""
    out = f"regexp_replace(regexp_replace(trim({url}), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
    host, rest = f"lower(regexp_extract({out}, '^([^/?]*)', 1))", f"regexp_extract({out}, '^[^/?]*(.*)$', 1)"
    host = f"regexp_replace(regexp_replace(regexp_replace({host}, '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '')"
    path, query = f"regexp_extract({rest}, '^([^?]*)', 1)", f"regexp_extract({rest}, '^[^?]*[?](.*)$', 1)"
    path = f"regexp_replace(regexp_replace({path}, '/index[.](html?|php)$', '/'), '/+$', '')"
    kept = f"array_to_string(list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^{TRACKING}(=|$)'))), '&')"
    return f"concat({host}, {path}, CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END)"


def _same(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), a == b)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _by_name(headers: Column) -> Column:
    """Headers by their names in lower case."""
    entries = F.array_sort(F.map_entries(headers))  # maps have no order
    names = F.array_distinct(F.transform(F.map_keys(headers), F.lower))
    values = lambda n: F.filter(F.transform(F.filter(entries, lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), F.isnotnull)
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(F.size(values(n)) > 0, F.array_join(values(n), ", "))))


def _place(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` are below ``value``: whole blocks first, then within one."""
    width = math.isqrt(len(cuts) - 1) + 1
    below = lambda a: F.size(F.filter(a, lambda b: b < value))
    blocks = cuts[width - 1 :: width]
    whole = below(F.array(*map(F.lit, blocks))) * width
    return whole + below(F.slice(F.array(*map(F.lit, cuts)), whole + 1, width))


def resolve_revisits(records: DataFrame, spans: int | None = None, span_rows: int = 500_000) -> DataFrame:
    """(record_id, canonical_url, response_id, outcome, digest, headers) of each revisit; outcome is resolved, unverified, mismatch or no_response.

    There are ``spans`` spans of time; by default so many that each has about ``span_rows`` different (URL, time), at most 10,000.
    """
    rows = records.select("record_id", "kind", "time", "etag", "last_modified", "digest", "headers", canonical_url(F.col("url")).alias("canonical_url"))
    usable = F.col("canonical_url").isNotNull() & F.col("time").isNotNull()
    found = F.struct("time", "record_id", "etag", "last_modified", "digest", "headers")
    answer = F.when(F.col("kind") == "response", found.withField("headers", F.to_json("headers")))
    again = F.col("kind") == "revisit"
    times = settled(rows.where(usable).groupBy("canonical_url", "time").agg(F.max(answer).alias("latest"), F.count_if(again).alias("_n")), "times")
    n, revisits = times.agg(F.count("*"), F.sum("_n")).first()
    spans = min(10_000, max(1, -(-n // span_rows))) if spans is None else spans
    cuts = [] if spans == 1 else sorted({float(b) for b in times.agg(F.percentile_approx(F.col("time").cast("double"), [k / spans for k in range(1, spans)], 10_000).alias("b")).first()[0] or []})
    # numbers, at most as many as spans; the first not below the time is found by halving
    span = F.lit(0) if not cuts else _place(F.col("time").cast("double"), cuts)
    times = times.withColumn("span", span)
    carried = Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    latest = times.groupBy("canonical_url", "span").agg(F.max("latest").alias("latest"))
    before = latest.withColumn("before", F.max("latest").over(carried)).select("canonical_url", "span", "before")
    # within a span: the latest response strictly before; a URL's times differ
    inside = Window.partitionBy("canonical_url", "span").orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    near = times.withColumn("inside", F.max("latest").over(inside)).where("_n > 0").join(before, ["canonical_url", "span"])
    near = settled(near.select("canonical_url", "time", "_n", F.coalesce("inside", "before").alias("r")), "answers")
    mine = rows.where(usable & again)
    joined_ = joined(mine, near, ["canonical_url", "time"], revisits or 0)
    r = F.col("r")
    check = F.coalesce(_same(F.col("digest"), r["digest"]), _same(_strong(F.col("etag")), _strong(r["etag"])), _same(F.col("last_modified"), r["last_modified"]))
    outcome = F.when(r.isNull(), "no_response").when(check.isNull(), "unverified").when(check, "resolved").otherwise("mismatch")
    joined_ = joined_.withColumn("outcome", outcome).withColumn("good", F.col("outcome").isin("resolved", "unverified"))
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce(_by_name(F.from_json(r["headers"], "map<string,string>")), none)
    new = F.map_filter(F.coalesce(_by_name(F.col("headers")), none), lambda k, _: ~k.isin(FORBIDDEN))
    kept = F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    merged = F.when(F.col("good"), F.map_from_entries(F.array_sort(F.concat(F.map_entries(kept), F.map_entries(new)))))
    out = joined_.select("record_id", "canonical_url", F.when(F.col("good"), r["record_id"]).alias("response_id"), "outcome", F.when(F.col("good"), r["digest"]).alias("digest"), merged.alias("headers"))
    lost = rows.where(~usable & (F.col("kind") == "revisit"))
    nothing = lost.select("record_id", "canonical_url", F.lit(None).cast(out.schema["response_id"].dataType).alias("response_id"), F.lit("no_response").alias("outcome"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionByName(nothing)


def page_captures(pages: DataFrame, later: int = 1000) -> DataFrame:
    """Records of a table of pages (page_id, url, html): each is crawled at the time of its number and revisited ``later``.

    The responses have all validators. A revisit has a weak entity tag, a digest, a date or none, by the last two bits of its page's number.
    """
    html, which = F.coalesce("html", F.lit("")), F.pmod("page_id", F.lit(4))
    tag, digest, date = F.md5(html), F.sha2(html, 256), F.concat(F.lit("d"), F.octet_length(html).cast("string"))
    base = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Content-Length"), F.octet_length(html).cast("string"), F.lit("Date"), F.col("page_id").cast("string"))
    first = pages.select((2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", F.col("page_id").alias("time"), tag.alias("etag"), date.alias("last_modified"), digest.alias("digest"), base.alias("headers"))
    again = F.create_map(F.lit("Date"), (F.col("page_id") + later).cast("string"), F.lit("Content-Length"), F.lit("0"), F.lit("Cache-Control"), F.lit("max-age=60"))
    validators = F.when(which == 0, F.concat(F.lit("W/"), tag)).alias("etag"), F.when(which == 2, date).alias("last_modified"), F.when(which == 1, digest).alias("digest")
    second = pages.select((2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", (F.col("page_id") + later).alias("time"), *validators, again.alias("headers"))
    return first.unionByName(second)
