"""Filtering URLs by host and path rules with short hash prefixes.

A rule is (verdict, host, path).  It fits a URL if the URL's host is the
rule's host or a subdomain of it and the URL's path starts with the rule's
path.  Each rule is filed under its host and the folder that its path ends in
(the path up to its last slash).  Each distinct URL is expanded into host
suffixes times folders of its path: those of a shape - number of host labels,
depth of the folder - that some rule has, so a URL of any length gives at
most as many expressions as the rules have shapes, each made in one pass over
the URL.  Both sides carry the SHA-256 of that expression: they are
equi-joined on its first four bytes, then the full digests are compared and
the rest of the rule's path is confirmed.  The longest fitting rule wins; of
equally long ones the one with the longer host, then a block.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased; path: from there up to ``?``, ``#`` or the end.  Null, or no
``://``: both empty, and no rule fits.  No fitting rule: ``allow``.
Repeated URLs are expanded once and every row gets its verdict.  A rule
without a host fits nothing; without a path it fits all paths.  No rules:
every verdict is ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PREFIX_DIGITS = 8           # hex digits of the digest that the join uses

# The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), folder), 256)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def _depth(path: Column) -> Column:
    """Slashes of a path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _expansions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the host suffixes and folders of the rules' shapes; a URL
    that is too short for a shape gives an expression that no rule fits."""
    def folder(depth):
        return F.concat(F.substring_index(path, "/", depth), F.lit("/")) if depth else F.lit("")
    return F.array_distinct(F.array(*(
        _expression(F.substring_index(host, ".", -labels), folder(depth)) for labels, depth in shapes)))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, host, path, rule, verdict) of each distinct URL of ``pages``.
    ``rules``: verdict, host, path."""
    rules = rules.where("host is not null").select(
        F.col("verdict").alias("r_verdict"), F.translate("host", _UPPER, _LOWER).alias("r_host"),
        F.coalesce("path", F.lit("")).alias("r_path")).distinct().withColumn(
        "r_digest", _expression(F.col("r_host"), F.regexp_extract("r_path", r"(?s)^(.*/)?[^/]*$", 1))).withColumn(
        "r_short", F.substring("r_digest", 1, PREFIX_DIGITS))
    # a few numbers, whatever the number of rules
    shapes = sorted((r["labels"], r["depth"]) for r in rules.select(
        _labels(F.col("r_host")).alias("labels"), _depth(F.col("r_path")).alias("depth")).distinct().collect())
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not shapes:
        return urls.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    spread = urls.where("host <> ''").select(
        "url", "host", "path", F.explode(_expansions(F.col("host"), F.col("path"), shapes)).alias("digest")).withColumn(
        "short", F.substring("digest", 1, PREFIX_DIGITS))
    fits = spread.join(rules, F.col("short") == F.col("r_short")).where(
        (F.col("digest") == F.col("r_digest")) & F.col("path").startswith(F.col("r_path"))
        & ((F.col("host") == F.col("r_host")) | F.col("host").endswith(F.concat(F.lit("."), F.col("r_host")))))
    best = fits.groupBy("url").agg(F.max(F.struct(
        (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
        F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule"))).alias("best"))
    return urls.join(best, "url", "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"))


def filter_pages(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every row of ``pages``."""
    rows = pages.select(id_col, F.col(url_col).alias("url"))
    scratch = Scratch(pages.sparkSession, "url_filter")
    judged = scratch.write(judge_urls(rows, rules, "url"), "judged")
    return rows.join(judged, "url", "left").select(
        id_col, F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
