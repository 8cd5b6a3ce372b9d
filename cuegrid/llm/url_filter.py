"""URL filter by a dated list: entries become validity intervals, captures are judged as of their fetch.

An entry (key, action, day, seq) holds for its key from its day until the day of
the key's next entry; seq settles entries of one day, the last one counts.  The
actions are block, allow and remove (nothing holds).  A key is a domain
(``example.net``: the host and what lies below it) or a host with leading path
segments (``example.net/a/b``).  Hosts are read without case, paths as they are.  A
capture looks up its host with its leading path segments, its host, and what its
host ends in, as far down as the list itself goes; the most specific entry that
holds at its fetch day decides.

Each distinct pair of URL and day is looked up once: its keys are exploded and
joined to the intervals in one join, and the most specific hit goes back to the
captures.  Spark broadcasts the list while its measured size is small and sorts and
merges (with AQE's split of skewed hosts) when it is not.

Defined results: a null or unusable URL, or a null day, matches nothing and is
allowed; very long URLs are read whole, and give no more keys than the list's deepest
entry has segments; entries with a null key, action or day are ignored; of entries of
one key and day the last counts; repeated captures are judged row by row; an empty
table gives no rows, an empty list allows all; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.stages import table


def _key(key: Column) -> Column:
    """The host part in lower case."""
    return F.concat(F.lower(F.regexp_extract(key, r"^([^/]*)", 1)), F.regexp_extract(key, r"^[^/]*(.*)$", 1))


def intervals(entries: DataFrame) -> DataFrame:
    """key, action, since, until (null: still holds), without removals and empty intervals."""
    w = Window.partitionBy("key").orderBy("day", "seq")
    known = entries.select(
        _key(F.col("key")).alias("key"),
        "action",
        F.col("day").cast("long").alias("day"),
        "seq",
    ).where("key IS NOT NULL AND action IS NOT NULL AND day IS NOT NULL")
    held = known.withColumn("until", F.lead("day").over(w))
    return held.where("action <> 'remove' AND (until IS NULL OR until > day)").select("key", "action", F.col("day").alias("since"), "until")


def lookup_keys(url: Column, segments: int, labels: int) -> Column:
    """An array of (rank, key), the most specific with the least rank: with up to so many path segments, the host, its last so many labels."""
    bare = F.regexp_replace(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^[^/@]*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/]*)", 1), r":[0-9]*$", ""), r"\.$", ""))
    host = F.when(host.rlike(r"^[^\s.]+(\.[^\s.]+)*$"), host)
    path = F.slice(F.filter(F.split(F.regexp_extract(bare, r"^[^/]*(/.*)$", 1), "/"), lambda x: x != ""), 1, max(1, segments))
    label = F.split(host, r"\.")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    key = lambda rank, k: F.struct(rank.cast("int").alias("rank"), k.alias("key"))
    paths = F.transform(
        upto(F.size(path)) if segments else F.array().cast("array<int>"),
        lambda k: key(-k, F.concat(host, F.lit("/"), F.array_join(F.slice(path, F.lit(1), k), "/"))),
    )
    ends = F.transform(upto(F.least(F.size(label) - 1, F.lit(labels))), lambda k: key(F.size(label) - k, F.array_join(F.slice(label, -k, k), ".")))
    return F.when(host.isNotNull(), F.concat(paths, F.array(key(F.lit(0), host)), ends))


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """The captures' page_id and day, the key that decided, its action, since when, and whether the capture is allowed."""
    held = intervals(entries)
    deep, wide = held.agg(F.max(F.size(F.split("key", "/")) - 1), F.max(F.size(F.split(F.regexp_extract("key", r"^([^/]*)", 1), r"\.")))).first()
    rows = captures.select(F.col("page_id"), F.col(url).alias("url"), F.col(day).cast("long").alias("fetch_day"))
    once = rows.where("url IS NOT NULL AND fetch_day IS NOT NULL").select("url", "fetch_day").distinct()
    asked = once.select("url", "fetch_day", F.explode(lookup_keys(F.col("url"), deep or 0, wide or 0)).alias("k"))
    side = held.select(F.col("key").alias("key_r"), "since", "until", "action")
    met = asked.join(
        side,
        (F.col("k.key") == F.col("key_r")) & (F.col("fetch_day") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetch_day") < F.col("until"))),
    )
    hit = met.groupBy("url", "fetch_day").agg(F.min_by(F.struct("key_r", "action", "since"), "k.rank").alias("hit"))
    out = rows.join(hit, ["url", "fetch_day"], "left")
    return out.select(
        "page_id",
        "fetch_day",
        F.col("hit.key_r").alias("matched_key"),
        F.col("hit.action").alias("action"),
        F.col("hit.since").alias("since"),
        (F.coalesce(F.col("hit.action"), F.lit("allow")) != "block").alias("allowed"),
    )


def listed(pages: DataFrame) -> DataFrame:
    """The dated list of the registered query, which grows with the pages: for each host, its last two labels, and host with first path segment, up to four entries told by the digits of the key's MD5."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    first = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    keys = pages.select(host.alias("host"), first.alias("first")).where("host <> ''").distinct()
    each = keys.select(
        F.explode(
            F.array(F.col("host"), F.substring_index("host", ".", -2), F.when(F.col("first") != "", F.concat("host", F.lit("/"), F.col("first")))),
        ).alias("key"),
    ).where("key IS NOT NULL").distinct()
    digits = each.withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "v",
        F.conv(F.substring(F.md5("key"), F.col("seq") * 2 + 1, F.lit(2)), 16, 10).cast("int"),
    )
    action = F.when(F.col("v") % 3 == 0, "block").when(F.col("v") % 3 == 1, "allow").otherwise("remove")
    return digits.where("v < 96").select(
        "key",
        action.alias("action"),
        (F.col("v") * 37 % 365).cast("long").alias("day"),
        F.col("seq").cast("long").alias("seq"),
    )


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """The pages carry no fetch time and no list comes with them: a day of the year stands for the one, derived from page_id, and `listed` for the other."""
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url", (F.pmod("page_id", F.lit(365)) * 7919 % 365).alias("fetch_day")), listed(pages))


OP3_SQL = r"""
WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) AS first FROM pages),
named AS (SELECT host AS key FROM hosts WHERE host <> '' UNION SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM hosts WHERE host <> '' UNION SELECT host || '/' || first FROM hosts WHERE host <> '' AND first <> ''),
digits AS (SELECT key, seq, CAST('0x' || substr(md5(key), CAST(seq * 2 + 1 AS BIGINT), 2) AS INTEGER) AS v FROM named, (VALUES (0), (1), (2), (3)) t(seq)),
listed AS (SELECT regexp_extract(lower(key), '^([^/]*)', 1) || regexp_extract(key, '^[^/]*(.*)$', 1) AS key, CASE v % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action, v * 37 % 365 AS day, seq FROM digits WHERE v < 96),
held AS (SELECT * FROM (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day, seq) AS until FROM listed) WHERE action <> 'remove' AND (until IS NULL OR until > since)),
caps AS (SELECT page_id, page_id % 365 * 7919 % 365 AS fetch_day, row_number() OVER () AS rid, regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', '') AS bare FROM pages),
parts AS (SELECT *, lower(regexp_extract(bare, '^([^/]*)', 1)) AS host, list_filter(string_split(regexp_extract(bare, '^[^/]*(/.*)$', 1), '/'), lambda x: x <> '') AS seg FROM caps),
keys AS (
  SELECT rid, host || '/' || seg[1] AS key, 1 AS rank FROM parts WHERE len(seg) >= 1
  UNION ALL SELECT rid, host, 2 FROM parts
  UNION ALL SELECT rid, array_to_string(string_split(host, '.')[-k:], '.'), 30 - k FROM (SELECT *, unnest(range(1, len(string_split(host, '.')))) AS k FROM parts)),
hits AS (SELECT rid, arg_min(struct_pack(k := h.key, a := h.action, s := h.since), k.rank) AS hit
  FROM keys k JOIN caps c USING (rid) JOIN held h ON h.key = k.key AND c.fetch_day >= h.since AND (h.until IS NULL OR c.fetch_day < h.until) GROUP BY rid)
SELECT page_id, CAST(fetch_day AS BIGINT) AS fetch_day, hit.k AS matched_key, hit.a AS action, CAST(hit.s AS BIGINT) AS since, coalesce(hit.a, 'allow') <> 'block' AS allowed
FROM caps LEFT JOIN hits USING (rid)
"""
