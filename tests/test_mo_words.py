"""Features of method by words: as the patterns find them, in a text cut into words once."""

import random
import re

from pyspark.sql import functions as F

from precinct import fixed
from precinct.functions import text


def plain(t):
    hit = lambda p: re.search(rf"(?<![A-Za-z0-9_])({p})(?![A-Za-z0-9_])", t, re.I | re.A)
    label = lambda of: next((k for k, p in of.items() if hit(p)), None)
    items = [m.group(1).lower() for m in re.finditer(rf"(?<![A-Za-z0-9_])({fixed.ITEMS})(?![A-Za-z0-9_])", t, re.I | re.A)]
    items = list(dict.fromkeys("jewellery" if w == "jewelry" else w for w in items))
    return (label(fixed.ENTRY), label(fixed.TARGET), label(fixed.TIME_OF_DAY), label(fixed.WEAPON), items, "group" if hit(fixed.GROUP) else "solo" if hit(fixed.SOLO) else None, label(fixed.VICTIM), label(fixed.PRECAUTION))


def test_words_find_what_the_patterns_find(spark):
    g = random.Random(5)
    parts = [p for of in (fixed.ENTRY, fixed.TARGET, fixed.TIME_OF_DAY, fixed.WEAPON, fixed.VICTIM, fixed.PRECAUTION) for v in of.values() for p in v.split("|") if "\\" not in p]
    parts += [*fixed.ITEMS.split("|"), *fixed.GROUP.split("|"), *fixed.SOLO.split("|"), "03:15", "09:59", "17:00", "23:59", "103:15", "3:150", "posed", "as", "by", "himself", "early", "ski", "é", "x_", "_", "K", "İ"]
    joins = [" ", "  ", "\n", "-", ", ", ".", "_", "é", "", ":"]
    change = [str, str.upper, str.title, lambda w: w.replace("k", "K").replace("i", "İ")]
    texts = ["".join(g.choice(change)(g.choice(parts)) + g.choice(joins) for _ in range(g.randrange(6))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: tuple(r["mo"]) for r in df.select("id", text.mo_features(F.col("text")).alias("mo")).collect()}
    assert all(got[k] == plain(t) for k, t in enumerate(texts))


def test_the_text_is_searched_for_few_patterns(spark):
    """One search a phrase or set of times, none a word: with one for each of 30 patterns the plan had 30."""
    df = spark.createDataFrame([("a",)], "text string").select(text.mo_features(F.col("text")).alias("mo"))
    analysed = df._jdf.queryExecution().analyzed().toString()
    assert "(smashed|" not in analysed and "arrays_overlap" in analysed
