"""URL filters: a list of host and path rules, and association rules mined from labelled URLs.

Tokens that are in the same labelled URLs, all of them, are one item, so that a URL repeated with
many tokens of its own is one item and not all their combinations; nothing is lost, as these
combinations have the same counts. FP-growth finds the combinations of items that are frequent
among blocked URLs. A combination becomes a rule if it has enough support, if enough of all
labelled URLs that hold it are blocked, and if no part of it does as well. Rules match by an
inverted index: each token names the rules that need it, and a URL fires the rules all of whose
tokens it has. The list judges its URLs by itself and teaches nothing.

Only Spark expressions and Spark ML's FP-growth are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch, sized_join

#: A mined rule rests on so many blocked URLs at least, whatever the number of labels, and so great a share of the labelled URLs it fits.
LEAST_SUPPORT, CONFIDENCE = 5, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; path: from there to ``?``, ``#`` or the end. Both are empty for null or without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of a list of (verdict, host and path such as ``net/es/``), and its verdict; else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: labels of the host, words of hyphened labels, path segments, keys of the query; digits become 0."""
    labels = F.split(host, "[.]")
    words = F.filter(F.flatten(F.transform(labels, lambda x: F.when(F.contains(x, F.lit("-")), F.split(x, "-")).otherwise(F.array().cast("array<string>")))), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&"), lambda x: x != "")

    def named(kind: str, tokens: Column) -> Column:
        return F.transform(tokens, lambda x: F.concat(F.lit(kind), F.regexp_replace(F.lower(x), "[0-9]+", "0")))

    keys = F.transform(query, lambda x: F.substring_index(x, "=", 1))
    last = F.filter(F.array(F.element_at(labels, -1)), lambda x: x != "")
    return F.array_distinct(F.concat(named("host:", F.filter(labels, lambda x: x != "")), named("word:", words), named("top:", last), named("path:", segments), named("key:", keys)))


def mine_rules(judged: DataFrame, scratch: Scratch, least_support: int = LEAST_SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (rule_id, tokens, blocked, seen, confidence) from rows (tokens, blocked)."""
    patterns = judged.groupBy(F.sort_array("tokens").alias("tokens")).agg(F.sum(F.col("blocked").cast("long")).alias("blocked"), F.count("*").alias("seen"))
    patterns = scratch.keep(patterns.withColumn("url_key", F.xxhash64("tokens")), "patterns")
    n = patterns.agg(F.coalesce(F.sum("blocked"), F.lit(0))).first()[0]
    if n < least_support:
        return judged.sparkSession.createDataFrame([], "rule_id long, tokens array<string>, blocked long, seen long, confidence double")
    held = patterns.select("url_key", "blocked", "seen", F.explode("tokens").alias("token"))
    alike = held.groupBy("token").agg(F.sum("blocked").alias("blocked"), F.count("*").alias("urls"), F.bit_xor(F.xxhash64("url_key")).alias("x"), F.bit_xor(F.xxhash64("url_key", F.lit(1))).alias("y"))
    tokens = scratch.keep(alike.where(F.col("blocked") >= least_support).select("token", F.xxhash64("urls", "x", "y").alias("item")), "tokens")
    items = scratch.keep(tokens.groupBy("item").agg(F.sort_array(F.collect_list("token")).alias("of_item"), F.min("token").alias("token")), "items")
    n_items = items.count()
    # One token of each item stands for it.
    lists = sized_join(held.where("blocked > 0").select("url_key", "blocked", "token"), items.select("token", "item"), "token", "inner", 64, n_items)
    lists = lists.groupBy("url_key", "blocked").agg(F.collect_set("item").alias("items"))
    lists = lists.select(F.explode(F.sequence(F.lit(1).cast("long"), "blocked")), "items").select("items")
    mined = FPGrowth(itemsCol="items", minSupport=min(1.0, least_support / n), minConfidence=1.0).fit(lists).freqItemsets
    sets = scratch.keep(mined.select(F.xxhash64(F.sort_array("items")).alias("set_id"), F.sort_array("items").alias("items")), "itemsets")
    n_parts = sets.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
    parts = scratch.keep(sized_join(sets.select("set_id", F.size("items").alias("needed"), F.explode("items").alias("item")), items, "item", "inner", 64, n_items), "parts")
    hits = sized_join(held, parts.select("set_id", "needed", "token"), "token", "inner", 64, n_parts)
    fired = hits.groupBy("url_key", "set_id").agg(F.count("*").alias("n"), F.first("needed").alias("needed"), F.first("blocked").alias("blocked"), F.first("seen").alias("seen")).where("n = needed")
    counts = fired.groupBy("set_id").agg(F.sum("blocked").alias("blocked"), F.sum("seen").alias("seen"))
    good = sets.join(counts, "set_id").withColumn("confidence", F.col("blocked") / F.col("seen")).where((F.col("confidence") >= confidence) & (F.col("blocked") >= least_support))
    good = scratch.keep(good, "confident")
    # A rule is redundant if dropping one of its items leaves a rule that is as confident.
    less = good.where(F.size("items") > 1).select("set_id", F.col("confidence").alias("own"), "items", F.explode("items").alias("gone"))
    less = less.select("set_id", "own", F.xxhash64(F.array_remove("items", F.col("gone"))).alias("part_id"))
    redundant = less.join(good.select(F.col("set_id").alias("part_id"), F.col("confidence").alias("theirs")), "part_id").where("theirs >= own").select("set_id").distinct()
    kept = good.join(redundant, "set_id", "left_anti").select("set_id", "blocked", "seen", "confidence")
    words = parts.join(kept, "set_id").groupBy("set_id", "blocked", "seen", "confidence").agg(F.sort_array(F.flatten(F.collect_list("of_item"))).alias("tokens"))
    return scratch.keep(words.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "blocked", "seen", "confidence"), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs (url_key, rule_id) of URLs (url_key, tokens) and the rules all of whose tokens they hold."""
    n_tokens = rules.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    index = rules.select("rule_id", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    hits = sized_join(urls.select("url_key", F.explode("tokens").alias("token")), index, "token", "inner", 64, n_tokens)
    return hits.groupBy("url_key", "rule_id").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n = needed").select("url_key", "rule_id")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labels: DataFrame | None = None, confidence: float = CONFIDENCE, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """page_id, host, path, rule (of the list, else null), verdict (allow or block) and mined (tokens of the mined rule that blocked, else null).

    URLs that the list judges are judged by it. The others are blocked if they hold all tokens of
    a rule that was mined from ``labels`` (page_id, blocked), and else allowed.

    Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
    of the list and is allowed unless mined rules say otherwise; repeated rows are returned each
    and repeated labels count each; rules that tie are told by their id; a very long URL is a row
    like any other; without blocked examples nothing is mined; an empty table gives an empty
    table; other columns of ``pages`` and ``labels`` are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    base = pages.select("page_id", url.alias("url")).withColumns({"host": host, "path": path})
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": name, "listed": verdict, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))})
    base = scratch.keep(base.withColumn("url_key", F.xxhash64("tokens")).drop("url"), "urls")
    if labels is not None:
        known = labels.where("page_id is not null and blocked is not null").select("page_id", "blocked")
        mined = mine_rules(base.select("page_id", "tokens").join(known, "page_id").select("tokens", "blocked"), scratch, least_support, confidence)
        open_urls = base.where("listed is null").groupBy("url_key").agg(F.first("tokens").alias("tokens"))
        best = sized_join(match_rules(open_urls, mined), mined, "rule_id", "inner", 256, mined.count())
        best = scratch.keep(best.groupBy("url_key").agg(F.max_by("tokens", F.struct("confidence", "blocked", "rule_id")).alias("mined")), "best")
        out = sized_join(base, best, "url_key", "left", 256, best.count())
    else:
        out = base.withColumn("mined", F.lit(None).cast("array<string>"))
    mined_rule = F.when(F.col("listed").isNull(), F.array_join("mined", " "))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("mined").isNotNull(), "block"), F.lit("allow")).alias("verdict"), mined_rule.alias("mined"))
