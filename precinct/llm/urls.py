"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

The models are variable-order Markov chains over characters (orders 0 to `order`), interpolated by Witten-Bell:
p_k(c|ctx) = (n(ctx,c) + t(ctx) p_{k-1}(c|shorter)) / (n(ctx) + t(ctx)), t the number of distinct characters seen after
ctx; a context that was never seen leaves p_{k-1} as it is. One chain learns from accepted URLs (those an allow rule
fits), one from rejected URLs (a block rule). A URL's score is the mean log10 ratio accepted/rejected a character. The
threshold is calibrated on the fifth of the ruled URLs that the chains don't learn from: of the score grid, the
value with the highest balanced accuracy, the lowest such on ties.

Null URLs and URLs without `://` have empty host and path. A null or empty URL scores 0. Without accepted or without
rejected URLs, the chains are the same uniform law, every score is 0 and every verdict without a rule is allow.
Repeated URLs get the same verdict; null page_ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from precinct.blocks.shared import materialize

#: The rule list, as given: (verdict, host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
ORDER = 4
#: Characters that a URL may hold, for the uniform law below order 0.
ALPHABET = 128
GRID = 0.01
START, END = "\x02", "\x03"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw_host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    host = lower_ascii(raw_host)
    path = F.regexp_extract(F.substring(rest, F.length(raw_host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _windows(urls: DataFrame, order: int) -> DataFrame:
    """(u, w): every character of a URL and of its end, each with the `order` characters before it."""
    padded = F.concat(F.lit(START * order), lower_ascii(F.col("url")), F.lit(END))
    at = F.explode(F.sequence(F.lit(1), F.length("url") + 1))
    return urls.select("*", at.alias("at")).withColumn("w", F.substring(padded, F.col("at"), F.lit(order + 1)))


def url_scores(urls: DataFrame, labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) for the distinct urls. labelled: (url, good boolean, weight) that the chains learn from.

    Counting goes over the distinct character windows, not over URLs, after one partial aggregation."""
    grams = _windows(labelled, order).groupBy("w").agg(
        F.sum(F.when(F.col("good"), F.col("weight")).otherwise(0)).alias("na"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("weight"))).alias("nr")
    )
    seen = _windows(urls, order)
    need = materialize(seen.groupBy("w").agg(F.count("*").alias("uses")), "url-windows")
    grams = materialize(grams, "url-grams")
    p = {g: F.lit(1.0 / ALPHABET) for g in "ar"}
    out = need
    for k in range(order + 1):
        ctx, char = F.substring("w", order + 1 - k, k) if k else F.lit(""), F.substring("w", order + 1, 1)
        count = grams.groupBy(ctx.alias("ctx"), char.alias("c")).agg(F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        total = count.groupBy("ctx").agg(*[f for g in "ar" for f in (F.sum(f"n{g}").alias(f"s{g}"), F.count(F.when(F.col(f"n{g}") > 0, 1)).alias(f"t{g}"))])
        out = out.withColumns({"ctx": ctx, "c": char}).join(count, ["ctx", "c"], "left").join(total, "ctx", "left")
        for g in "ar":
            n, s, t = (F.coalesce(F.col(f"{x}{g}"), F.lit(0)) for x in "nst")
            out = out.withColumn(f"p{g}", F.when(s > 0, (n + t * p[g]) / (s + t)).otherwise(p[g]))
        p = {g: F.col(f"p{g}") for g in "ar"}
        out = out.select("w", "pa", "pr")
    ratio = out.select("w", (F.log10("pa") - F.log10("pr")).alias("part"))
    return seen.join(ratio, "w").groupBy("url").agg((F.sum(F.round("part", 9).cast("decimal(28,9)")).cast("double") / F.count("*")).alias("score"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold for every row of pages."""
    pages = pages.select("page_id", "url")
    urls = pages.filter("url is not null").groupBy("url").agg(F.count("*").alias("weight"))
    host, path = host_path(F.col("url"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = urls.select("url", "weight", longest_rule(host, path, rules)["verdict"].alias("ruled"))
    urls = materialize(urls.repartition(tasks, "url"), "urls")  # many small files: each URL becomes dozens of windows
    fit = F.crc32("url") % 5 > 0
    ruled = urls.filter("ruled is not null").select("url", (F.col("ruled") == "allow").alias("good"), F.lit(1).alias("weight"), fit.alias("fit"))
    both = ruled.agg(F.count_if(F.expr("fit and good")).alias("a"), F.count_if(F.expr("fit and not good")).alias("r")).first()
    if both["a"] and both["r"]:
        scores = materialize(url_scores(urls.select("url"), ruled.filter("fit").drop("fit"), order), "url-scores")
        limit = calibrate(scores.join(ruled.filter("not fit"), "url"))
    else:
        scores, limit = urls.select("url", F.lit(0.0).alias("score")), urls.limit(1).agg(F.lit(0.0).alias("threshold"))
    return (
        pages.withColumns({"host": host, "path": path})
        .withColumn("_r", longest_rule(F.col("host"), F.col("path"), rules))
        .join(scores, "url", "left")
        .crossJoin(F.broadcast(limit))  # one row
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
        .select(
            "page_id", "host", "path", F.col("_r.rule").alias("rule"),
            F.coalesce(F.col("_r.verdict"), F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")).alias("verdict"),
            "score", "threshold",
        )
    )


def calibrate(scored: DataFrame) -> DataFrame:
    """One row (threshold): of the grid's values, the one with the highest balanced accuracy; 0 without both kinds."""
    bins = scored.groupBy((F.floor(F.col("score") / GRID) * GRID).alias("at")).agg(F.count_if(F.col("good")).alias("a"), F.count_if(F.expr("not good")).alias("r"))
    below = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # the grid has a few hundred values
    every = Window.partitionBy()
    kept = bins.withColumns({"ta": F.sum("a").over(every), "tr": F.sum("r").over(every), "la": F.coalesce(F.sum("a").over(below), F.lit(0)), "lr": F.coalesce(F.sum("r").over(below), F.lit(0))})
    gain = F.try_divide(F.col("ta") - F.col("la"), F.col("ta")) + F.try_divide(F.col("lr"), F.col("tr"))
    return kept.select("at", gain.alias("gain")).agg(F.coalesce(F.min_by("at", F.struct(-F.col("gain"), F.col("at"))), F.lit(0.0)).alias("threshold"))
