"""URL filter by host and path rules, with hash-prefix look-up (DataFrame functions only).

Every URL is expanded into the pairs (suffix of its host, prefix of its path) that a rule could name. Rules and pairs
meet in an equi-join on a short prefix of their SHA-256, full digests confirm the match, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join uses as its key.
PREFIX_DIGITS = 8
#: Bytes of rules that are sent to every executor at most; more are joined by a shuffle, dealt over so many salts.
MAX_BROADCAST_BYTES = 16 << 20
SALTS = 32


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without :// or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without :// or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict for every row of pages (page_id, url).

    rules has host, path and verdict (block, or anything else for allow). A rule fits its host and all subdomains where
    the URL's path starts with the rule's path. Of several, the longest host and path together wins, then the longer
    host, then block before allow. Null and malformed URLs have empty host and path and get the default verdict with a
    null rule, as do URLs without a rule. Repeated rows give repeated results; an empty table gives an empty result.

    The rules that fit one URL differ in the lengths of host and path, so these, with the verdict, are all that is kept
    of a match: one number, whose maximum is the winner.
    """
    rules = rules.select("host", "path", (F.col("verdict") == "block").cast("bigint").alias("blocks")).groupBy("host", "path").agg(F.max("blocks").alias("blocks"))
    lengths = [r[0] for r in rules.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]  # bounded by the longest path

    digest = rule_key(F.col("host"), F.col("path"))
    host_length, both = F.length("host").cast("bigint"), (F.length("host") + F.length("path")).cast("bigint")
    rules = rules.select(F.left(digest, F.lit(PREFIX_DIGITS)).alias("short"), digest.alias("rule_digest"), (F.shiftleft(both, 24) + F.shiftleft(host_length, 1) + F.col("blocks")).alias("rank"))
    size = rules.agg(F.count(F.lit(1))).first()[0] * 160
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: rule_key(s, p))))
    asked = urls.withColumn("digest", F.explode_outer(pairs)).withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))

    if size <= MAX_BROADCAST_BYTES:
        found = asked.join(F.broadcast(rules), "short", "left")
    else:  # very many URLs may ask for one key, such as that of a whole top-level domain
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        found = asked.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(rules.withColumn("salt", salts), ["short", "salt"], "left")
    best = F.max(F.when(F.col("digest") == F.col("rule_digest"), F.col("rank"))).alias("best")
    judged = found.groupBy("row", "page_id", "host", "path").agg(best)
    own = F.shiftright(F.col("best"), 1).bitwiseAND((1 << 23) - 1).cast("int")
    rule = F.concat(F.right("host", own), F.left("path", F.shiftright(F.col("best"), 24).cast("int") - own))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best") % 2 == 1, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.when(F.col("best").isNotNull(), rule).alias("rule"), verdict.alias("verdict"))
