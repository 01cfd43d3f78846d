"""URL filters: host/path rules applied by a sort-merge range join.

A host is written with its labels reversed and closed by dots
(``www.example.com`` -> ``com.example.www.``).  Then "this host and all its
subdomains" is a prefix of that key, a prefix is an interval of the sorted keys,
and intervals of a rule set are nested or disjoint.  The same holds for path
prefixes below one host.  ``_sweep`` sorts points and interval ends together and
carries the stack of open intervals along (a running ``last`` window): every
point sees what is open at its place.  Two sweeps judge a URL: one over host
intervals gives the chain of rule hosts above it, one over path intervals below
each of these hosts gives the longest fitting path.

Only DataFrame functions are used.  Sweeps are cut into groups (top two labels,
or the rule host); a group with more points than ``_group_rows`` is salted and
its rules, not its points, are copied to each salt.  The salted groups number at
most points / group_rows = 8 x shuffle partitions, hence the broadcast.

Defined cases: a null URL or one without ``://`` has an empty host and path and
gets the default verdict with a null rule; an empty path never starts with a
rule's ``/``; repeated URLs are judged row by row; of repeated rules the first by
(verdict) is kept; rules with a null or empty host are ignored; an empty rule
table gives every row the default; other input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reclink.llm.common import shuffle_partitions

_LAST = "\U0010ffff"  # sorts after every continuation of a prefix


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _top(host: Column) -> Column:
    """The last two labels of a host, as a key: the group of a host sweep."""
    return host_key(F.substring_index(host, ".", -2))


def rule_table(spark, rules) -> DataFrame:
    """(verdict, 'host/path') pairs -> rule rows (verdict, host, path, rule)."""
    rows = [(v, r.split("/", 1)[0], "/" + r.split("/", 1)[1] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _group_rows(points: DataFrame) -> int:
    return max(256, points.count() // (8 * shuffle_partitions(points.sparkSession)))


def _sweep(points: DataFrame, intervals: DataFrame, rows: int) -> DataFrame:
    """points (g, key, id..) x intervals (g, key, open, closed): adds ``state``.

    ``open`` is the state from the interval's start on, ``closed`` the state
    after its end.  Both tables are already grouped by ``g``.
    """
    big = (points.groupBy("g").count().where(F.col("count") > rows)
           .select("g", F.ceil(F.col("count") / rows).cast("int").alias("salts")))
    spread = lambda df: df.join(F.broadcast(big), "g", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    pts = spread(points).select("g", F.pmod(F.xxhash64("id", "key"), F.col("salts")).cast("int").alias("salt"),
                                "key", F.lit(1).alias("kind"), F.lit(None).cast(intervals.schema["open"].dataType).alias("ev"),
                                F.struct(*[c for c in points.columns if c not in ("g", "key")]).alias("pt"))
    iv = spread(intervals).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    none = F.lit(None).cast(pts.schema["pt"].dataType).alias("pt")
    starts = iv.select("g", "salt", "key", F.lit(0).alias("kind"), F.col("open").alias("ev"), none)
    ends = iv.select("g", "salt", F.concat("key", F.lit(_LAST)).alias("key"), F.lit(2).alias("kind"),
                     F.col("closed").alias("ev"), none)
    w = Window.partitionBy("g", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (pts.unionByName(starts).unionByName(ends)
            .withColumn("state", F.last("ev", ignorenulls=True).over(w))
            .where("kind = 1").select("g", "key", "pt.*", "state"))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Per URL row: id, host, path, rule, verdict of the longest fitting rule.

    ``rules``: verdict, host, path.  Length is that of ``host + path``; ties go to
    the longer host.  Output: (id_col, host, path, rule, verdict).
    """
    base = urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select(
        "id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rules = (rules.where("host IS NOT NULL AND host <> ''")
             .groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
             .agg(F.min("verdict").alias("verdict")))
    rows = _group_rows(base)

    # Host intervals: a rule host opens the chain of all rule hosts above and including it.
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    above = hosts.select("host", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))).alias("up"))
    chains = (above.join(hosts.select(F.col("host").alias("up")), "up")
              .groupBy("host").agg(F.sort_array(F.collect_set("up")).alias("open")))
    chains = chains.withColumn("closed", F.array_remove("open", F.col("host"))).withColumn("key", host_key(F.col("host")))
    single = ~F.col("host").contains(".")
    tops = base.select(_top(F.col("host")).alias("g"), F.substring_index("host", ".", -1).alias("last")).distinct()
    host_iv = (chains.where(~single).select(_top(F.col("host")).alias("g"), "key", "open", "closed")
               .unionByName(chains.where(single).select(F.col("host").alias("last"), "key", "open", "closed")
                            .join(tops, "last").select("g", "key", "open", "closed")))
    pts = base.select(_top(F.col("host")).alias("g"), host_key(F.col("host")).alias("key"), "id", "host", "path")
    seen = _sweep(pts, host_iv, rows).select("id", "host", "path", F.col("state").alias("chain"))

    # Path intervals below each rule host: the open state is the longest fitting path rule.
    hp = rules.select("host", "path", "verdict")
    rule_struct = F.struct(F.length(F.concat("host", "path")).alias("len"), F.length("host").alias("hlen"),
                           F.concat("host", "path").alias("rule"), "verdict")
    parents = (hp.select("host", F.col("path").alias("full"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("k"))
               .where("k < length(full)").withColumn("path", F.expr("substring(full, 1, k)"))
               .join(hp, ["host", "path"]).withColumn("r", rule_struct)
               .groupBy("host", "full").agg(F.max("r").alias("closed")))
    none = F.struct(F.lit(0).alias("len"), F.lit(0).alias("hlen"), F.lit(None).cast("string").alias("rule"),
                    F.lit(None).cast("string").alias("verdict"))
    path_iv = (hp.withColumn("open", rule_struct)
               .join(parents.withColumnRenamed("full", "path"), ["host", "path"], "left")
               .select(F.col("host").alias("g"), F.col("path").alias("key"), "open",
                       F.coalesce("closed", none).alias("closed")))
    # One number per row keeps repeated ids apart while the chain is expanded.
    seen = seen.withColumn("rid", F.struct("id", "host", "path"))
    asked = (seen.where(F.size("chain") > 0).select("rid", F.explode("chain").alias("g"))
             .distinct().select("g", F.col("rid.path").alias("key"), F.col("rid").alias("id")))
    best = (_sweep(asked, path_iv, rows).where("state.rule IS NOT NULL")
            .groupBy("id").agg(F.max("state").alias("best"))
            .select("id.id", "id.host", "id.path", "best"))
    same = [F.col("s.id").eqNullSafe(F.col("b.id"))] + [F.col(f"s.{c}") == F.col(f"b.{c}") for c in ("host", "path")]
    return (seen.alias("s").join(best.alias("b"), same, "left")
            .select(F.col("s.id").alias(id_col), "s.host", "s.path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
