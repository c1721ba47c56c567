"""Operator 1, URL filters: expressions of a URL, joined to rules by short hash prefixes.

A rule is (host, path, verdict). It fits its host and all subdomains where the URL's
path starts with the rule's path. Every URL is expanded into host suffixes times path
prefixes; expressions meet rules on the first 32 bits of a SHA-256 digest, the full
digest confirms, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import other_columns_aside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_behind_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _host_suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels) - k + 1), "."),
    )


@other_columns_aside("url")
def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` (a ``url`` column and any others) plus ``host, path, rule, verdict``.

    Of the rules that fit, the longest (host and path together) wins, then the longer
    host, then ``block`` before ``allow``. ``rule`` is host and path as one string, null
    where none fits; ``verdict`` is then ``default``. A null URL or one without ``://``
    has empty host and path. Repeated pages stay repeated; a page column that is called
    like an added one is replaced. Rules with null host or verdict take no part, a null
    path counts as empty, and rule hosts are lower-cased like those of URLs.

    Only distinct (host, path) pairs are expanded, so a URL or host that many pages
    share costs one row; the sides are broadcast only where Spark's size limit allows.
    """
    base = pages.drop("host", "path", "rule", "verdict")
    base = base.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).filter("rule_host IS NOT NULL AND rule_verdict IS NOT NULL")
    rules = rules.withColumns(_keys(F.concat("rule_host", "rule_path"), "rule_digest"))
    # The only path prefixes worth a look are as long as some rule's path.
    lengths = rules.agg(F.collect_set(F.length("rule_path"))).scalar()
    places = base.select("host", "path").distinct()
    suffixes = places.withColumn("_suffix", F.explode(_host_suffixes(F.col("host"))))
    expressions = (
        suffixes.withColumn("_length", F.explode(lengths))
        .filter(F.col("_length") <= F.length("path"))
        .withColumn("_text", F.concat("_suffix", F.substring("path", F.lit(1), F.col("_length"))))
        .withColumns(_keys(F.col("_text"), "_digest"))
    )
    found = (
        expressions.join(rules, "prefix")
        .filter(F.col("_digest") == F.col("rule_digest"))
        # A digest covers host and path as one text; the parts must agree as well.
        .filter((F.col("_suffix") == F.col("rule_host")) & (F.col("_length") == F.length("rule_path")))
        .groupBy("host", "path")
        .agg(
            F.max(
                F.struct(
                    F.length("_text").alias("size"),
                    F.length("_suffix").alias("host_size"),
                    (F.col("rule_verdict") == "block").alias("blocks"),
                    F.col("_text").alias("rule"),
                    F.col("rule_verdict").alias("verdict"),
                )
            ).alias("_best")
        )
    )
    joined = base.join(found, ["host", "path"], "left")
    return joined.select(
        *base.columns,
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )


def _keys(text: Column, digest: str) -> dict[str, Column]:
    whole = F.sha2(text, 256)
    return {digest: whole, "prefix": F.substring(whole, 1, PREFIX_DIGITS)}
