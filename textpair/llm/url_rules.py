"""URL filter rules as a sort-merge range join.

A rule is a host and a path prefix.  With the host's labels reversed, a rule is
a prefix of canonical keys ``org.example/en/...`` and so an interval; intervals
of prefixes are nested or disjoint.  Rules give two sorted boundaries each: at
its start the rule becomes the innermost active one, at its end the rule around
it is again.  Pages give one key per suffix of their host, because a rule also fits
subdomains; suffixes of more labels than any rule has fit none and get no key.  One sorted sweep over
boundaries and keys hands every key the innermost active rule, the top of the
stack; a page keeps the longest rule of its keys.

Every sweep takes a share of the pages, dealt by row number, and all
boundaries.  A host that holds a third of the pages is spread over all sweeps,
and the pages are shuffled once, without their contents.

Edge cases: a null url, or one without ``://``, has empty host and path and fits
no rule; equal rules with different verdicts block; repeated pages are judged
separately; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textpair.llm.common import ascii_lower

# Fixed by contract.
BASE_RULES = (
    ("net/", "block"),
    ("example.net/en/", "allow"),
    ("example.com/de/", "block"),
    ("org/fr/", "allow"),
)
# The list's own rules for hosts of advertising and spam.
LIST_RULES = tuple(
    (f"{name}.example.{top}/", "block")
    for name in ("casino-win", "cheap-pills", "spam-farm")
    for top in ("com", "net", "org")
)
RULE = "struct<size:int,rule:string,verdict:string>"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def canonical(host: Column, path: Column) -> Column:
    """Reversed labels, then the path: a rule's key is a prefix of what it fits.

    A zero byte ends the host, so the prefix of a host ends at a whole label.
    """
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("\0"), path).cast("binary")


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``rule, verdict`` rows from pairs such as ``("example.org/en/", "block")``."""
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def boundaries(rules: DataFrame) -> DataFrame:
    """``key, top`` sorted by key: the innermost active rule from ``key`` on."""
    clean = (
        rules.where("rule IS NOT NULL").groupBy("rule").agg(F.max("verdict").alias("verdict"))
        .select(
            F.struct(F.length("rule").alias("size"), "rule", "verdict").cast(RULE).alias("top"),
            canonical(
                F.substring_index("rule", "/", 1),
                F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)"),
            ).alias("key"),
        )
    )
    # The rule around a rule is the longest other key that is a prefix of it.
    prefixes = clean.select(
        F.col("key").alias("inner"), F.explode(F.sequence(F.lit(1), F.greatest(F.length("key") - 1, F.lit(1)))).alias("n")
    ).select("inner", F.expr("substring(inner, 1, n)").alias("key")).where("key != inner")
    around = (
        prefixes.join(clean, "key").groupBy("inner").agg(F.max(F.struct(F.length("key"), "top")).alias("o"))
        .select(F.col("inner").alias("key"), F.col("o.top").alias("outer"))
    )
    none = F.struct(F.lit(0).alias("size"), F.lit(None).alias("rule"), F.lit(None).alias("verdict")).cast(RULE)
    starts = clean.select("key", "top")
    ends = clean.join(around, "key", "left").select(
        F.concat("key", F.lit(b"\xff")).alias("key"), F.coalesce("outer", none).alias("top")
    )
    return starts.union(ends)


def longest_rules(rows: DataFrame, rules: dict[str, DataFrame], sweeps: int, deepest: int) -> DataFrame:
    """Add one struct column per rule table to rows with ``host`` and ``path``: the longest rule that fits.

    ``deepest`` is the largest number of labels of a rule's host: a longer suffix of a page's host fits no rule.
    """
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_sweep", (F.col("_row") % sweeps).cast("int"))
    labels = F.split("host", "[.]")
    # Only a non-empty host is a host; its suffixes start at each of its labels.
    suffixes = F.transform(
        F.sequence(F.greatest(F.size(labels) - (deepest - 1), F.lit(1)), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    payload = F.struct(*rows.columns)
    keys = numbered.select(
        "_sweep", "_row", payload.alias("_payload"), F.explode(suffixes).alias("_suffix")
    ).select("_sweep", "_row", "_payload", canonical(F.col("_suffix"), F.col("_payload.path")).alias("_key"))
    names = list(rules)
    events = keys.withColumn("_page", F.lit(True))
    for name in names:
        events = events.withColumn(name, F.lit(None).cast(RULE))
    for name in names:
        copies = boundaries(rules[name]).withColumn("_sweep", F.explode(F.sequence(F.lit(0), F.lit(sweeps - 1))))
        events = events.unionByName(
            copies.select("_sweep", F.col("key").alias("_key"), F.lit(False).alias("_page"), F.col("top").alias(name)),
            allowMissingColumns=True,
        )
    order = Window.partitionBy("_sweep").orderBy("_key", "_page").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select(
        "_sweep", "_row", "_payload", "_page",
        *[F.last(name, ignorenulls=True).over(order).alias(name) for name in names],
    ).where("_page")
    # The rows of a page are in one sweep: this grouping needs no shuffle.
    best = swept.groupBy("_sweep", "_row").agg(
        F.first("_payload").alias("_payload"), *[F.max(name).alias(name) for name in names]
    )
    return best.select("_payload.*", *names)


def judge(pages: DataFrame, base=BASE_RULES, extra=LIST_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, list_rule`` for every page.

    The longest base rule decides; without one the longest rule of the list;
    without that the page is allowed.
    """
    spark = pages.sparkSession
    sweeps = int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = host_and_path(pages["url"])
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = longest_rules(
        rows, {"_base": rule_table(spark, base), "_list": rule_table(spark, extra)}, sweeps,
        max((len(rule.split("/")[0].split(".")) for rule, _ in (*base, *extra) if rule), default=1),
    )
    return judged.select(
        "page_id", "host", "path", F.col("_base.rule").alias("rule"),
        F.coalesce("_base.verdict", "_list.verdict", F.lit("allow")).alias("verdict"),
        F.col("_list.rule").alias("list_rule"),
    )
