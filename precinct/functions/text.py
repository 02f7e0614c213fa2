"""Narratives: tokens, keyword classes, severity, sentiment, threat and modus operandi, all as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precinct import fixed


def tokens(text: Column) -> Column:
    """Maximal runs of letters or hyphens, lower-cased."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}-]+)"), 1)


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def classify(tok: Column) -> Column:
    """struct(crime_type, confidence) of the type with the highest keyword score; 'unknown' without any."""
    known = _words(sorted({w for kw in fixed.KEYWORDS.values() for w in kw}))

    def scores(t: Column) -> Column:
        found, n = t["found"], F.greatest(t["n"], F.lit(1))
        total = lambda kw: sum((F.when(F.array_contains(found, w), float(x)).otherwise(0.0) for w, x in kw.items()), F.lit(0.0))
        return F.array_sort(F.array(*[F.struct((-(total(fixed.KEYWORDS[k]) / n)).alias("s"), F.lit(k).alias("t")) for k in sorted(fixed.KEYWORDS)]))

    def result(ranked: Column) -> Column:  # highest score first, then the alphabet
        best, second = -ranked[0]["s"], -ranked[1]["s"]
        found = F.struct(ranked[0]["t"].alias("crime_type"), (best / (best + second + 1e-9)).alias("confidence"))
        return F.when(best > 0, found).otherwise(F.struct(F.lit("unknown").alias("crime_type"), F.lit(0.0).alias("confidence")))

    small = _let(tok, lambda t: F.struct(F.array_intersect(known, t).alias("found"), F.size(t).alias("n")))
    return _let(_let(small, scores), result)


def severity(tok: Column, crime_type: Column) -> Column:
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in fixed.SEVERITY.items() for x in kv]), crime_type), F.lit(0.3))
    boost = F.size(F.array_intersect(_words(fixed.BOOST_WORDS), tok)) * 0.05
    return F.least(base + F.least(boost, F.lit(0.2)), F.lit(1.0))


def sentiment(tok: Column) -> Column:
    def feel(c: Column) -> Column:
        return F.when(c["neg"] + c["pos"] == 0, 0.0).otherwise((c["pos"] - c["neg"]) / (c["neg"] + c["pos"] + 1e-9))

    count = lambda t, words: F.size(F.filter(t, lambda w: w.isin(words)))
    return _let(_let(tok, lambda t: F.struct(count(t, fixed.NEGATIVE_WORDS).alias("neg"), count(t, fixed.POSITIVE_WORDS).alias("pos"))), feel)


def threat(tok: Column, feeling: Column) -> Column:
    return (feeling < -0.5) & F.arrays_overlap(tok, _words(fixed.THREAT_WORDS))


def _word(pattern: str) -> str:
    """Whole words by ASCII rules, whatever the regex engine's own."""
    return rf"(?i)(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])"


def _split_pattern(pattern: str) -> tuple[list[str], list[str], list[str]]:
    """Alternatives that are a word, those that are several with blanks between, and all others (times)."""
    kinds = ([], [], [])
    for p in pattern.split("|"):
        kinds[0 if re.fullmatch("[a-z0-9_]+", p) else 1 if re.fullmatch("[a-z0-9_ ]+", p) else 2].append(p)
    return kinds


def _holds(text: Column, seen: Column, pattern: str) -> Column:
    """Whether the text holds the pattern as whole words. seen: its known words, and whether it has a time. Only texts that have all words
    of a phrase, or a time, are searched again."""
    single, phrases, times = _split_pattern(pattern)
    found = seen["found"]
    tests = [F.arrays_overlap(found, _words(single))] if single else []
    tests += [(F.size(F.array_intersect(_words(sorted(set(p.split()))), found)) == len(set(p.split()))) & text.rlike(_word(p)) for p in phrases]
    tests += [seen["clock"] & text.rlike(_word("|".join(times)))] if times else []
    return reduce(lambda a, b: a | b, tests)


def mo_features(text: Column, chars: int | None = None) -> Column:
    """Of the whole text, or of its first `chars` characters. The text is cut into words once, whatever the number of patterns."""
    t = F.coalesce(text, F.lit(""))
    t = t if chars is None else F.substring(t, 1, chars)
    groups = [fixed.ENTRY, fixed.TARGET, fixed.TIME_OF_DAY, fixed.WEAPON, fixed.VICTIM, fixed.PRECAUTION]
    patterns = [p for g in groups for p in g.values()] + [fixed.GROUP, fixed.SOLO]
    known = sorted({w for p in patterns for kind in _split_pattern(p)[:2] for q in kind for w in q.split()})
    split = F.split(F.lower(F.regexp_replace(t, "[^A-Za-z0-9_]+", " ")), " ")  # ASCII alone is left when it is lower-cased
    seen = _let(split, lambda w: F.struct(F.array_intersect(_words(known), w).alias("found"), F.array_intersect(w, _words(fixed.ITEMS.split("|"))).alias("items"), t.rlike("[0-9]:[0-9]").alias("clock")))

    def features(s: Column) -> Column:
        label = lambda of: F.coalesce(*[F.when(_holds(t, s, p), name) for name, p in of.items()])
        items = F.transform(s["items"], lambda w: F.when(w == "jewelry", "jewellery").otherwise(w))
        return F.struct(
            label(fixed.ENTRY).alias("entry_method"), label(fixed.TARGET).alias("target_type"), label(fixed.TIME_OF_DAY).alias("time_of_day"),
            label(fixed.WEAPON).alias("weapon_type"), F.array_distinct(items).alias("items_taken"),
            F.when(_holds(t, s, fixed.GROUP), "group").when(_holds(t, s, fixed.SOLO), "solo").alias("solo_or_group"),
            label(fixed.VICTIM).alias("victim_profile"), label(fixed.PRECAUTION).alias("precaution"),
        )

    return _let(seen, features)


def canonical_mo(mo: Column) -> Column:
    parts = ["entry_method", "target_type", "time_of_day", "weapon_type", "items_taken", "solo_or_group", "victim_profile", "precaution"]
    return F.concat_ws(" ", *[mo[p] for p in parts])


def nlp_enrich(df: DataFrame, text: str = "narrative") -> DataFrame:
    """All text features of a row in one projection."""
    out = df.withColumn("_tok", tokens(F.col(text))).withColumn("_class", classify(F.col("_tok"))).withColumn("nlp_sentiment", sentiment(F.col("_tok")))
    out = out.withColumns({"nlp_type": F.col("_class.crime_type"), "nlp_confidence": F.col("_class.confidence")})
    out = out.withColumns({"nlp_severity": severity(F.col("_tok"), F.col("nlp_type")), "nlp_threat": threat(F.col("_tok"), F.col("nlp_sentiment")), "mo": mo_features(F.col(text))})
    return out.withColumn("mo_text", canonical_mo(F.col("mo"))).drop("_tok", "_class")


def token_set_jaccard(a: Column, b: Column) -> Column:
    """Of the space-separated lower-case words; 0 if either side is empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def crime_bucket(kind: Column) -> Column:
    k = F.lower(F.coalesce(kind, F.lit("")))
    has = lambda *w: k.rlike("|".join(w))
    return F.when(has("burgl"), "burglary").when(has("theft", "larcen", "shoplift"), "theft").when(has("assault", "violent", "robbery", "homicide", "weapon"), "violent").otherwise("other")


def near_repeat_band(kind: Column) -> Column:
    """struct(metres, days, multiplier) of a crime type."""
    key = F.replace(F.lower(F.coalesce(kind, F.lit(""))), F.lit(" "), F.lit("_"))
    row = lambda v: F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("metres", "days", "multiplier"), strict=True)])
    table = F.create_map(*[x for k, v in fixed.NEAR_REPEAT.items() for x in (F.lit(k), row(v))])
    return F.coalesce(F.element_at(table, key), row(fixed.NEAR_REPEAT_DEFAULT))
