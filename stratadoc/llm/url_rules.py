"""URL filter rules by a sorted sweep over reversed-host keys. DataFrame functions only.

A host's labels, reversed and each followed by "/", make its key (www.example.com:
com/example/www/), so the hosts whose rules a url falls under have the keys that its own
starts with, one for each of its labels. Under each of these keys a rule is the interval
of paths from its own to its own followed by 0xFF, which UTF-8 never holds. Intervals of
one host are nested or apart: a start puts its rule on the stack of active rules, an end
takes it off again, so it carries the rule around it, and the last rule that a sorted
sweep has seen is the longest that holds. The longest over a url's keys wins.

The sweep is a window over (key, salt), the union of urls and interval ends in the order
of their paths. Keys with over 1 / (4 * partitions) of the urls (com, say) are spread
over salts; interval ends, which come from the rule table alone, are copied to the salts
of their own key. A url carries no rule but the one last seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import ascii_lower, checkpoint, shuffle_partitions

#: Rule hosts that may be broadcast, to leave out the keys that have no rule; with more, all keys of a url are swept.
MOST_BROADCAST = 1_000_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path of a url; both empty for null or without ://."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


def host_keys(host: Column) -> Column:
    """The keys of a host and of all hosts that it is a subdomain of, its own last."""
    labels = F.reverse(F.split(host, r"\."))
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "/"), F.lit("/")))


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, at, rule): the innermost rule of a key's host from path `at` (bytes) on; a rule of nulls where none is left. rules: host, path, verdict."""
    r = (
        rules.select(ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where("host <> '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # of two verdicts for one rule, block holds
        .withColumn("rule", F.struct("host", "path", "verdict"))
    )
    shorter = F.expr("transform(filter(sequence(0, length(path)), n -> n < length(path)), n -> substring(path, 1, n))")
    around = r.select("host", F.col("path").alias("inner"), F.explode(shorter).alias("path")).join(r.select("host", "path", F.col("rule").alias("outer")), ["host", "path"])
    around = around.groupBy("host", F.col("inner").alias("path")).agg(F.max_by("outer", F.length("path")).alias("outer"))
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")])
    key, at = host_key(F.col("host")).alias("key"), F.col("path").cast("binary")
    ends = r.join(around, ["host", "path"], "left").select(key, F.concat(at, F.lit(b"\xff")).alias("at"), F.coalesce("outer", none).alias("rule"))
    return r.select(key, at.alias("at"), "rule").unionByName(ends)


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", slices: int | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url).

    rules: host, path, verdict ("allow" or "block"). A rule fits its host and all
    subdomains, if the url's path starts with the rule's. The longest rule (host and
    path together, then host) wins; of equal rules with both verdicts, block. Without
    a rule: rule null, verdict `default`. Rules with a null or empty host or a null
    verdict are passed over; a null rule path is empty. Null urls and urls without ://
    have empty host and path. Repeated rows stay repeated; an empty rule table gives
    `default` for all; an empty page table an empty result. Other columns are ignored.
    slices: about how many parts the sweep is dealt into.
    """
    slices = slices or 4 * shuffle_partitions(pages.sparkSession)
    host, path = host_path(F.col("url"))
    ends = checkpoint(interval_ends(rules))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.explode(host_keys(host)).alias("key")).withColumn("own", F.col("key") == host_key(F.col("host")))
    hosts = ends.select("key", F.lit(True).alias("ruled")).distinct()
    if hosts.limit(most_broadcast + 1).count() <= most_broadcast:
        urls = urls.join(F.broadcast(hosts), "key", "left").where("own or ruled")
    rows = checkpoint(urls.groupBy("key").agg(F.count("*").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    often = rows.where(F.col("n") * slices > total).select("key", F.ceil(F.col("n") * slices / F.lit(max(total, 1))).cast("int").alias("salts"))  # at most slices + keys of a url
    spread = lambda df, salt: df.join(F.broadcast(often), "key", "left").withColumn("salt", salt).drop("salts")
    urls = spread(urls, F.coalesce(F.pmod(F.xxhash64("page_id", "host", "path"), F.col("salts")), F.lit(0)).cast("int"))
    ends = spread(ends, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    both = urls.select("key", "salt", F.col("path").cast("binary").alias("at"), F.lit(1).alias("is_url"), "page_id", "host", "path", "own").unionByName(ends.withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    swept = Window.partitionBy("key", "salt").orderBy("at", "is_url").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("rule", F.last("rule", ignorenulls=True).over(swept)).where("is_url = 1")
    size = F.when(F.col("rule.host").isNotNull(), F.struct((F.length("rule.host") + F.length("rule.path")).alias("n"), F.length("rule.host").alias("h"), "rule"))
    # A row has its own key once, so a sum of these counts the rows that repeat.
    best = found.groupBy("page_id", "host", "path").agg(F.max(size).alias("best"), F.sum(F.col("own").cast("int")).alias("copies"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "page_id",
        "host",
        "path",
        F.concat("best.rule.host", "best.rule.path").alias("rule"),
        F.coalesce("best.rule.verdict", F.lit(default)).alias("verdict"),
    )
