"""URL rules and a listed-URL filter.

Host rules decide first: the longest rule (host and path prefix) that fits.
Every other url is judged by a list of canonical urls. A blocked Bloom filter,
one row of eight 64-bit words per block, lets possible members through; an
exact hash join with the list removes its false positives.

The number of blocks follows the size of the list. The filter is broadcast
while its counted rows are few; beyond that it is joined by block, and urls
(pre-aggregated, so that a url which is a third of all rows is one row) meet
the list in a shuffle join.

Defined cases: a null url, or one without "://", has an empty host and path,
no rule and verdict allow; equal urls get equal verdicts; an empty list allows
all; columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.catalog import query
from lumenframe.llm.rows import small
from lumenframe.operators.relational import attach
from lumenframe.session import cut

# (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
WORDS = 8              # 64-bit words of a block: one cache line
BITS_PER_URL = 12
PROBES = 6             # bits set in a block
SPAM_HOSTS = "^(?:[^.]+\\.)*(?:casino-win|cheap-pills|free-bets|ads-track)\\."


def url_host(url: Column) -> Column:
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    path = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(path, F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www., path without closing slashes, query parameters in
    order without tracking ones (utm_*, ref); scheme and fragment are dropped.
    Null if there is no host."""
    host, path = F.regexp_replace(url_host(url), "^www\\.", ""), F.regexp_replace(url_path(url), "/+$", "")
    query_part = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query_part, "&"), lambda p: (p != "") & ~p.rlike("^(?:utm_[^=]*|ref)(?:=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, tail))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null if none fits."""
    names, verdicts = None, None
    for verdict, of, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(prefix)
        names = F.when(fits, of + prefix) if names is None else names.when(fits, of + prefix)
        verdicts = F.when(fits, verdict) if verdicts is None else verdicts.when(fits, verdict)
    return (names, verdicts) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _probes(url: Column, blocks: int) -> list[Column]:
    """Block number, then the bits (as a mask) in each of its words."""
    h = F.xxhash64(url)
    places = F.xxhash64(url, F.lit(1))
    at = [F.shiftrightunsigned(places, 9 * i).bitwiseAND(64 * WORDS - 1) for i in range(PROBES)]
    one = F.lit(1).cast("long")
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for p in at:
            bit = F.call_function("shiftleft", one, p.bitwiseAND(63).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftrightunsigned(p, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        masks.append(mask.alias(f"w{w}"))
    return [F.pmod(h, F.lit(blocks)).alias("block"), *masks]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..): the filter of the urls in column ``url``. Blocks without urls have no row."""
    return listed.select(*_probes(F.col("url"), blocks)).groupBy("block").agg(
        *[F.bit_or(f"w{w}").alias(f"f{w}") for w in range(WORDS)])


def listed_urls(urls: DataFrame, listed: DataFrame, bits_per_url: int = BITS_PER_URL) -> DataFrame:
    """Distinct non-null urls (column ``url``) that are on the list."""
    listed = cut(listed.select("url").filter("url IS NOT NULL").distinct())
    blocks = max(1, -(-listed.count() * bits_per_url // (64 * WORDS)))
    table = small(cut(bloom(listed, blocks)))
    probe = urls.select("url", *_probes(F.col("url"), blocks))
    all_set = F.lit(True)
    for w in range(WORDS):
        all_set = all_set & (F.col(f"f{w}").bitwiseAND(F.col(f"w{w}")) == F.col(f"w{w}"))
    possible = probe.join(table, "block").filter(all_set).select("url").distinct()
    return possible.join(listed, "url", "left_semi")


def judge_urls(df: DataFrame, listed: DataFrame, url: str = "url",
               rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``df`` with host, path, rule and verdict. ``listed`` (url): canonical urls to block."""
    host, path = url_host(F.col(url)), url_path(F.col(url))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": rule, "_ruled": verdict})
    out = out.withColumn("_canonical", F.when(F.col("_ruled").isNull(), canonical(F.col(url))))
    open_urls = out.filter("_canonical IS NOT NULL").select(F.col("_canonical").alias("url"))
    hits = cut(listed_urls(open_urls, listed))
    hit = hits.select(F.col("url").alias("_canonical"), F.lit(True).alias("_hit"))
    # Measured by bytes: broadcast, or a shuffle join salted by the other columns, which also spreads rows that a rule decided.
    return (attach(out, hit, ["_canonical"], "left")
            .withColumn("verdict", F.coalesce("_ruled", F.when(F.col("_hit"), "block").otherwise("allow")))
            .drop("_canonical", "_ruled", "_hit"))


@query(f"""
    WITH p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END r FROM pages),
    h AS (SELECT *, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
                 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') path,
                 coalesce(regexp_extract(r, '^[^?#]*\\?([^#]*)', 1), '') q FROM p),
    c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') ||
                 coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(q, '&'),
                     lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[^=]*|ref)(?:=|$)'))), '&'), ''), '') canon FROM h),
    v AS (SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM c),
    listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '{SPAM_HOSTS}'))
    SELECT page_id, host, path, rule,
           CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow'
                     WHEN 'org/fr/' THEN 'allow'
                     ELSE CASE WHEN host <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END END AS verdict
    FROM v
""")
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the host rules, then under a list: here the
    canonical urls of all pages on hosts with an advertising label, as no list is given."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    listed = pages.filter(url_host(F.col("url")).rlike(SPAM_HOSTS)).select(canonical(F.col("url")).alias("url"))
    return judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")
