"""Filters of addresses by host and path: expressions of an address meet the rules by short hash prefixes.

An address is expanded into host-suffix and path-prefix expressions, of the shapes that the rules have: so many labels,
so many characters of the path. Their SHA-256 meet the rules' by an equi-join on the first characters; what meets is
confirmed by the whole digest, and the longest rule decides. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that are joined on.
PREFIX = 8
#: Rules up to this number go to every executor, about 200 bytes each; more of them meet the expressions in a shuffle.
BROADCAST_RULES = 200_000
#: Shares into which a hash prefix is dealt in that shuffle, as one expression (a common top-level domain) may be in every row.
SALTS = 64
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty for null and where `://` is missing."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty for null and where `://` is missing."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _labels(name: Column) -> Column:
    return F.size(F.split(name, r"\."))


def expressions(name: Column, folder: Column, shapes: list[tuple[int, int]]) -> Column:
    """An array of suffix + prefix, one for each shape (labels of the host, characters of the path) that the address has."""
    one = lambda labels, chars: F.when((_labels(name) >= labels) & (F.char_length(folder) >= chars), F.concat(F.substring_index(name, ".", -labels), F.substring(folder, 1, chars)))
    return F.array_compact(F.array(*[one(*x) for x in shapes])) if shapes else F.array().cast("array<string>")


def judge(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """urls with host, path, rule and verdict; columns of these names are replaced, all others stay.

    rules: host, path, verdict. A rule fits its host and all subdomains, if the address' path starts with the rule's; the
    longest rule (host and path together) wins, of equally long ones that with the longer host, of repeated ones `block`.
    `rule` is the rule's host and path, null where none fits; there the verdict is `default`. Rules with a null or empty
    host, or a path that isn't empty and doesn't start with `/`, fit nothing. Give only the columns of urls that are needed,
    as they go through a shuffle, once with few rules, once an expression with more than broadcast_rules of them. A null address or one without `://` has an
    empty host and path, so no rule fits. Repeated rows and null ids stay row for row; an empty table gives no rows.
    """
    spark = urls.sparkSession
    digest = lambda c: F.sha2(c, 256)
    given = rules.select(F.translate("host", _UPPER, _LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict")
    given = given.where((F.col("h") != "") & (F.col("p").startswith("/") | (F.col("p") == "")))
    table = given.withColumn("full", digest(F.concat("h", "p"))).select(
        F.substring("full", 1, PREFIX).alias("short"),
        F.col("full").alias("rule_full"),
        F.struct((F.char_length("h") + F.char_length("p")).alias("length"), F.char_length("h").alias("host_length"), (F.col("verdict") == BLOCK).alias("blocks"), F.concat("h", "p").alias("rule"), F.col("verdict").alias("verdict")).alias("found"),
    )
    # A few whole numbers, whatever the number of rules: the shapes, and how many rules there are.
    counted = given.groupBy(_labels(F.col("h")).alias("labels"), F.char_length("p").alias("chars")).count().collect()
    shapes, many = sorted((r["labels"], r["chars"]) for r in counted), sum(r["count"] for r in counted)

    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    own = [f"c{i}" for i in range(len(kept))]
    rows = urls.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(kept, own)], host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    if not shapes:
        found = rows.withColumn("found", F.lit(None).cast("struct<rule:string,verdict:string>"))
    else:
        # An address and all its expressions stay in one task from the scan to the shuffle, so its number there is told once.
        asked = rows.withColumn("row_id", F.monotonically_increasing_id()).withColumn("expression", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes)))
        asked = asked.withColumn("full", digest(F.col("expression"))).withColumn("short", F.substring("full", 1, PREFIX))
        if many <= broadcast_rules:
            met = asked.join(F.broadcast(table), "short", "left")
        else:
            dealt = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = asked.withColumn("salt", (F.col("row_id") % SALTS).cast("int")).join(dealt, ["short", "salt"], "left")
        confirmed = F.max(F.when(F.col("full") == F.col("rule_full"), F.col("found")))
        found = met.groupBy("row_id").agg(confirmed.alias("found"), F.any_value(F.struct(*own, "host", "path")).alias("row")).select("row.*", "found")
    return found.select(*[F.col(o).alias(c) for c, o in zip(kept, own)], "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
