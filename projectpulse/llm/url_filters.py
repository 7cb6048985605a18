"""URL filters: pattern rules indexed by their rarest literal token.

A rule lists the literal tokens that any URL it fits must contain: whole host labels and whole path
segments. Among them the one that the fewest of the given URLs contain becomes its index key. The
tokens of a URL fetch candidate rules by an equi-join, and only candidates are tried as regular
expressions. The longest rule that fits wins (of equally long ones the first by its text); a URL
that no rule fits gets ``default``.

URLs are reduced to distinct (host, path) pairs first, so a hot URL costs one row. Built-in
functions only.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there
up to ``?``, ``#`` or the end. Cases: a null URL or one without ``://`` has an empty host and path and is judged
like any other; a rule without a whole literal token is a candidate for every URL; repeated rows
are judged alike; an empty table gives an empty result; columns of the input that are named like
one of the results are replaced.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULE = "array<struct<rule:string,verdict:string,pattern:string,tokens:array<string>,weight:int>>"
#: token that every URL has, for rules without a literal one
ANY = "*"


def parse_rule(text: str, verdict: str) -> dict:
    """A rule ``host/path``: the host and its subdomains, paths that start with the path."""
    host, slash, path = text.partition("/")
    path = slash + path
    tokens = [f"h:{label}" for label in host.split(".") if label]
    tokens += [f"p:{part}" for part in path.split("/")[1:-1] if part]  # the last part may go on in the URL
    own = rf"(?:[^/]*\.)?{re.escape(host)}" if host else "[^/]*"
    return {"rule": text, "verdict": verdict, "pattern": f"^{own}(?=/|$){re.escape(path)}", "tokens": tokens or [ANY], "weight": len(text)}


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as rows: rule, verdict, pattern (on host and path), tokens, weight."""
    if not rules:
        return spark.sql("select '' rule, '' verdict, '' pattern, array('') tokens, 0 weight where false")
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rules)), RULE)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substr({u}, locate('://', {u}) + 3)".format(u="`_url`"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The input's columns with host, path, rule (null if none fits) and verdict."""
    host, path = host_and_path(F.col("_url"))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.withColumn("_url", F.col(url_col)).select(*kept, host.alias("host"), path.alias("path"))
    urls = split.select("host", "path").distinct()
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x))
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.concat(labels, parts, F.array(F.lit(ANY))))).alias("token"))

    # the rarest token of every rule over the given URLs
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(wanted, "token", "left_semi").groupBy("token").count()
    ranked = rules.select("rule", "verdict", "pattern", "weight", F.explode("tokens").alias("token")).join(seen, "token", "left")
    index = ranked.groupBy("rule", "verdict", "pattern", "weight").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))

    fits = tokens.join(index, "token").where(F.regexp_like(F.concat("host", "path"), F.col("pattern")))
    order = F.struct((-F.col("weight")).alias("w"), "rule", "verdict")
    best = fits.groupBy("host", "path").agg(F.min(order).alias("_best"))
    judged = split.join(best, ["host", "path"], "left")
    return judged.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
