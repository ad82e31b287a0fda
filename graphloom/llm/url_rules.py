"""URL rules by expressions: host suffixes times path prefixes, matched on short hash prefixes, confirmed on full digests.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import BROADCAST_ROWS, materialise, sized_broadcast

#: Hex digits of a digest that the equi-join sees.
SHORT = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ://."""
    at = F.coalesce(F.position(F.lit("://"), url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


OWN = ("host", "path", "rule", "verdict")


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", carry: tuple[str, ...] = ()) -> DataFrame:
    """urls with host, path, rule and verdict; the columns named in carry come along, one that is named like any of these
    four as source_host and so on.

    rules(verdict, host, path): a rule fits its host and all subdomains if the path starts with its path; of those that
    fit, the one with the longest host and path together wins, then the longer host, then the smaller text and verdict.
    A rule with a null host or path fits nothing. Without a rule that fits, rule is null and the verdict is default. Null
    URLs and URLs without :// have an empty host and path. Repeated rows stay repeated.

    A URL is expanded into its host suffixes of as many labels as some rule has, times its path prefixes of as many
    characters as some rule has; both sets are as small as the rules make them, and no other expression could match.
    Rules that are too many to broadcast are first narrowed to those that some URL's expressions meet.
    """
    rules = rules.select(F.col("verdict").alias("r_verdict"), F.lower("host").alias("r_host"), F.col("path").alias("r_path"))
    rules = rules.where("r_host is not null and r_path is not null")
    rules = rules.withColumn("labels", F.size(F.split("r_host", r"\."))).withColumn("chars", F.length("r_path"))
    shapes = rules.groupBy().agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    digest = _digest(F.col("r_host"), F.col("r_path"))
    table = rules.select("r_verdict", "r_host", "r_path", digest.alias("r_digest"), F.substring(digest, 1, SHORT).alias("short"))

    host, path = host_and_path(F.col(url_col))
    carried = F.struct(*[F.col(c).alias(f"source_{c}" if c.lower() in OWN else c) for c in carry], F.lit(0).alias("__"))
    rows = urls.select(carried.alias("carried"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid"))
    labels, chars = sorted(shapes.labels), sorted(shapes.chars)
    # suffixes: the last k labels, where the host has so many
    parts = F.split("host", r"\.")
    none = F.lit(None).cast("string")
    suffixes = F.filter(F.array(none, *[F.when(F.size(parts) >= k, F.substring_index("host", ".", -k)) for k in labels]), lambda x: x.isNotNull())
    prefixes = F.filter(F.array(none, *[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in chars]), lambda x: x.isNotNull())

    def expressions(urls: DataFrame) -> DataFrame:
        tried = urls.withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes))
        tried = tried.withColumn("digest", _digest(F.col("suffix"), F.col("prefix")))
        return tried.withColumn("short", F.substring("digest", 1, SHORT))

    if shapes.n > BROADCAST_ROWS:
        met = expressions(rows.where("host <> ''").select("host", "path").distinct()).select("short").distinct()
        table = materialise(table.join(met, "short", "left_semi"), "url-rules")
        table = sized_broadcast(table, table.count())
    else:
        table = F.broadcast(table)  # at most BROADCAST_ROWS rows
    hits = expressions(rows).join(table, "short", "left")
    hits = hits.withColumn("fits", F.expr("digest = r_digest and suffix = r_host and prefix = r_path"))
    # a URL's expressions are together, so all but one of its rows go before the shuffle; no key has more than one URL
    rank = F.struct((-F.length("r_host") - F.length("r_path")).alias("l"), (-F.length("r_host")).alias("h"), "r_host", "r_path", "r_verdict")
    best = hits.groupBy("rid").agg(F.min(F.when(F.col("fits"), rank)).alias("won"), F.first("carried").alias("carried"), F.first("host").alias("host"), F.first("path").alias("path"))
    columns = [F.col("carried").getField(f.name).alias(f.name) for f in best.schema["carried"].dataType.fields if f.name != "__"]
    return best.select(*columns, "host", "path", F.concat("won.r_host", "won.r_path").alias("rule"), F.coalesce("won.r_verdict", F.lit(default)).alias("verdict"))
