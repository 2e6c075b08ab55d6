"""URL filters by a sort-merge range join over reversed-host keys.

A host's canonical key is its labels in reverse order, each followed by a dot
(``www.example.net`` becomes ``net.example.www.``), so a rule's host and all its
subdomains are the keys that begin with the rule's key: an interval. Intervals
of rules nest or are apart, never cross. Both kinds of rows are sorted by key
and swept once with the stack of active rules: its level n is the interval of the
last rule host of n labels that began, a next one of n labels takes its place (they
never nest in each other), and a key beyond the interval finds it closed. The
sweep is one window that looks back to the last start of each level; a start event
holds the path rules of its own host only. A url takes the longest rule of its
stack whose path its own path begins with.

Pages are dealt evenly over parts, whatever their host, and each part gets a copy
of the start events. That keeps a hot host from landing in one task. Parts hold
``PART_ROWS`` pages, or four times as many as there are rules if these are more, so
that rule lists of any length are taken and their copies stay fewer than the pages.

Cases: a null url, or one without ``://``, has an empty host and path and takes
the default verdict; empty and very long urls are read whole; rules that repeat
count once, and of equal ones with different verdicts block wins; of rules of
equal length the one with the longer host wins; repeated pages each come back;
an empty page table gives an empty result, an empty rule list the default
verdict for all. Other columns pass through; those named host, path, rule or
verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fablespark.llm.common import columns_but, literal_rows, quoted, shuffle_width

#: (host, path, verdict).
DEFAULT_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
#: Pages that are swept in one part, if there are many.
PART_ROWS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, level, own): the start of each rule host's interval, its labels and its path rules."""
    clean = (
        rules.filter("host is not null and path is not null and verdict is not null")
        .groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("key", host_key(F.col("host")))
    )
    rule = F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "path", "verdict", F.concat("host", "path").alias("rule"))
    return clean.groupBy("key").agg(F.collect_list(rule).alias("own")).select("key", (F.size(F.split("key", r"\.")) - 1).alias("level"), "own")


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, default_verdict: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` (with a url) and host, path, rule, verdict."""
    spark = pages.sparkSession
    if rules is None:
        rules = literal_rows(spark, DEFAULT_RULES, ["host", "path", "verdict"])
    starts = rule_events(rules)
    levels = [r["level"] for r in starts.select("level").distinct().collect()]  # a host has few labels
    n_pages, n_rules = pages.count(), rules.count()
    size = max(PART_ROWS, 4 * n_rules)
    parts = min(max(shuffle_width(spark), -(-n_pages // size)), max(1, n_pages // max(1, 4 * n_rules)))
    names = columns_but(pages, "host", "path", "rule", "verdict")
    url = F.col("url")
    rows = pages.select(*quoted(names), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.select(F.struct("*").alias("page"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"))
    events = starts.select("key", F.lit(0).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "level", "own")
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = [F.last(F.when(F.col("level") == n, F.struct("key", "own")), ignorenulls=True).over(sweep).alias(f"slot{n}") for n in levels]
    swept = rows.unionByName(events, allowMissingColumns=True).select("page", "key", "kind", *slots).filter("kind = 1")
    stack = F.filter(F.array(*[F.col(f"slot{n}") for n in levels]), lambda x: x.isNotNull() & F.startswith("key", x["key"])) if levels else None
    fits = lambda r: F.startswith(F.col("page.path"), r["path"])
    best = F.array_max(F.filter(F.flatten(F.transform(stack, lambda x: x["own"])), fits)) if levels else F.lit(None).cast("struct<rule:string,verdict:string>")
    page = F.col("page")
    return swept.select("page", best.alias("best")).select(*[page.getField(c).alias(c) for c in [*names, "host", "path"]], F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default_verdict)).alias("verdict"))


ORACLE_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS tail FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
         translate(coalesce(regexp_extract(tail, '^[^/?#]*', 0), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest),
ranked AS (
  SELECT p.*, r.*, row_number() OVER (PARTITION BY n ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(rverdict, 'allow') AS verdict FROM ranked WHERE k = 1
"""
