"""URL filters: listed rules first, mined association rules for the rest.

Listed rules are (verdict, host, path) triples.  A rule fits its host and all subdomains if the
url's path starts with the rule's path; the longest host + path wins.  Urls that a listed rule
decides are the labelled examples from which Spark's FP-growth mines token combinations;
rules "tokens -> label" that reach the minimum support and confidence judge the other urls.

Matching goes through an inverted index: every mined rule is filed under its rarest token, the
distinct token sets of the urls are joined to that index on one token, and the rule fits where
all its tokens are present.  Work per url is the number of rules filed under its tokens.

Only DataFrame operations and ``pyspark.ml``'s FP-growth are used; no Python runs in tasks.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and the
default verdict; without labelled urls (an empty table) nothing is mined and the default holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retrospark.llm.common import ascii_lower, materialize

#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_AFTER = r"://([^/?#]*)"
_PATH = r"://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _AFTER, 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


def listed_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tested first
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments and query keys; digits become ``0``."""
    h, p = host(url), path(url)
    shape = lambda c: F.regexp_replace(ascii_lower(c), r"[0-9]+", "0")
    tagged = lambda parts, tag: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), shape(x)))
    query = F.coalesce(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.split(query, "&"), lambda kv: F.element_at(F.split(kv, "="), 1))
    return F.array_sort(F.array_distinct(F.concat(tagged(F.split(h, r"\."), "h:"), tagged(F.split(p, "/"), "p:"), tagged(keys, "q:"))))


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float = 1.0) -> DataFrame:
    """Rules (rule_id, tokens, label, confidence, support, lift) from ``labelled`` (tokens, label).

    FP-growth keeps no url: its result is bounded by the support threshold.
    """
    tag = "label="
    if not labelled.limit(1).count():
        return labelled.sparkSession.createDataFrame([], "rule_tokens array<string>, label string, confidence double, support double, lift double")
    baskets = labelled.select(F.array_distinct(F.concat("tokens", F.array(F.concat(F.lit(tag), F.col("label"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules
    is_label = lambda x: x.startswith(tag)
    return (
        rules.where(is_label(F.get("consequent", F.lit(0))) & ~F.exists("antecedent", is_label) & (F.col("lift") > min_lift))
        .select(
            F.array_sort("antecedent").alias("rule_tokens"),
            F.substring(F.get("consequent", F.lit(0)), len(tag) + 1, 1 << 30).alias("label"),
            "confidence",
            "support",
            "lift",
        )
    )


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Best mined rule per distinct token set: (tokens, label, confidence, mined).

    Best is highest confidence, then support, then most tokens, then the tokens in order.
    """
    sets = token_sets.select("tokens").distinct()
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    by_token = rules.select("rule_tokens", F.explode("rule_tokens").alias("token")).distinct().join(counts, "token", "left")
    rarest = by_token.groupBy("rule_tokens").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("token"))
    index = rules.join(rarest, "rule_tokens")
    hits = (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    )
    order = F.struct(F.col("confidence"), F.col("support"), F.size("rule_tokens"), F.col("rule_tokens"), F.col("label"))
    return hits.groupBy("tokens").agg(F.max(order).alias("best")).select(
        "tokens", F.col("best.label").alias("label"), F.col("best.confidence").alias("confidence"), F.concat_ws(" ", "best.rule_tokens").alias("mined")
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.7,
    default: str = "allow",
) -> DataFrame:
    """Judge every url: page_id, host, path, rule, verdict, mined (token rule), confidence.

    One row per input row; columns other than page_id and url are ignored.
    """
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), url_tokens(F.col("url")).alias("tokens"))
    urls = urls.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    urls = urls.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    labelled = urls.where(F.col("listed").isNotNull()).select("tokens", F.col("listed.verdict").alias("label"))
    mined = materialize(mine_rules(labelled, min_support, min_confidence))
    best = match_rules(urls.where(F.col("listed").isNull()), mined)
    out = urls.join(best, "tokens", "left")
    listed = F.col("listed").isNotNull()
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("listed.rule").alias("rule"),
        F.coalesce(F.col("listed.verdict"), F.col("label"), F.lit(default)).alias("verdict"),
        F.when(~listed, F.col("mined")).alias("mined"),
        F.when(~listed, F.col("confidence")).alias("confidence"),
    )
