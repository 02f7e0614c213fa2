"""The corpus operators against brute force on small fixtures, with the cases that break things."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from precinct.llm import brown, decontaminate, encode, lines, media, ngrams, packing, substrings, toxicity, urls
from precinct.llm.common import HashedWords, letter_words, space_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n int"


def fixture(rows):
    return [(i, t, None, "src", len(t or ""), "clash", 1) for i, t in rows]


def some_texts():
    g = random.Random(7)
    vocab = [a + b for a in "the of and ing er on".split() for b in ["", "st", "re", "ti", "ly", "é"]]
    base = [" ".join(g.choice(vocab) for _ in range(60)) for _ in range(6)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10 + k, t) for k, t in enumerate(base[:3])]  # copies
    near = base[0].split()
    near[30] = "changed"
    rows += [(20, " ".join(near)), (21, base[1] + "\n" + base[2]), (22, ""), (23, None), (24, "  \n\n "), (25, "one two"), (26, "ONE  Two"), (27, "x" * 20_000), (28, base[3] * 40)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(some_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# -- 1


def word_model(*words):
    """A character model that expects these words."""
    n = np.full((28, 28, 28), 0.01)
    for w in words:
        for a, b, c in zip("##" + w + "#", "#" + w + "#", w + "#", strict=False):
            f = lambda x: toxicity.CODE.get(x, toxicity.EDGE)
            n[f(a), f(b), f(c)] += 10
            if a == "#" and b == "#":
                n[:, f(b), f(c)] += 1
    return np.log(n / n.sum(2, keepdims=True))


def test_channel_restores_words():
    ch = toxicity.Channel(word_model("idiot", "moron", "trash", "stupid", "such", "know", "you", "garbage", "a", "i"))
    assert ch.words("1d10t m0r0n tr@sh") == {"idiot", "moron", "trash"}
    assert ch.words("1diot 5tupid 7rash 9arbage !diot +rash") == {"idiot", "stupid", "trash", "garbage"}
    assert ch.words("stuupid iddiot idiooooot i.d.i.o.t m-o-r-o-n") == {"stupid", "idiot", "moron"}
    assert "idiot" in ch.words("you i d i o t") and {"such", "idiot"} <= ch.words("s u c h i d i o t") and {"idiot", "know"} <= ch.words("i d i o t k n o w")
    assert ch.words("such, (know)! you.") == {"such", "know", "you"} and ch.words("") == set()


@settings(deadline=None, max_examples=80)
@given(st.text("ab1@$ .3", min_size=1, max_size=6), st.integers(0, 5))
def test_decoding_is_the_best_path(text, seed):
    """Viterbi against all paths of the lattice."""
    model = np.log(np.random.default_rng(seed).dirichlet(np.ones(28), (28, 28)))
    ch = toxicity.Channel(model)

    def cost(path):
        x = y = toxicity.EDGE
        total = sum(price for _, price in path)
        for c in "".join(letters for letters, _ in path):
            z = toxicity.EDGE if c == " " else toxicity.CODE.get(c, toxicity.OTHER)
            total -= model[x, y, z]
            x, y = y, z
        return total - model[x, y, toxicity.EDGE]

    paths = {"".join(letters for letters, _ in p): cost(p) for p in sorted(itertools.product(*ch.readings(text)), key=cost, reverse=True)}
    assert math.isclose(paths[ch.decode(text)], min(paths.values()), rel_tol=1e-9)


@settings(deadline=None, max_examples=60)
@given(st.from_regex(r"[a-d]{0,3}(aa|bb)[a-d]{0,3}", fullmatch=True), st.integers(0, 5))
def test_one_doubled_letter(word, seed):
    ch = toxicity.Channel(np.log(np.random.default_rng(seed).dirichlet(np.ones(28), (28, 28))))
    assert ch.undoubled(word) == ch.decode(word)
    assert toxicity.features("losez", "llosez") == ["=losez", "^llos", "^llose"] and toxicity.features("") == []


def test_toxicity_learns_and_holds_out(spark):
    g = random.Random(3)
    rows = [(k, " ".join("".join(g.choice("abcdeimno") for _ in range(5)) for _ in range(20)) + (" idiot" if k % 4 == 0 else "")) for k in range(300)] + [(900, None), (901, "1d1ot")]
    d = spark.createDataFrame(fixture(rows), SCHEMA)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score_toxicity(d, labels))
    assert len(got) == len(rows)
    assert all(got[k]["predicted"] == int(k % 4 == 0) and 0 <= got[k]["score"] <= 1 for k in range(300))
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert got[900]["predicted"] == 0
    assert toxicity.score_toxicity(d, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0
    twice = d.filter("doc_id < 10").union(d.filter("doc_id < 10")).union(spark.createDataFrame(fixture([(950, "idiot " * 50_000), (None, "idiot")]), SCHEMA))
    again = [r for r in toxicity.score_toxicity(d.union(twice), labels).collect() if r["doc_id"] in (None, 950, 4)]
    assert len(again) == 5 and all(r["predicted"] == 1 for r in again)


# -- 2


def test_media_round_trip(docs, empty):
    got = by_id(media.documents_as_media(docs))
    for i, t in some_texts():
        raw = (t or "").encode()
        p = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["caption"] == f"bytes of document {i}"
    assert media.documents_as_media(empty).count() == 0


def test_interleaved_order():
    items = media.parse_sequence('<h1>T</h1><script>no</script><p>a <b>b</b><figure><img src="sha256:d1" alt="old"><figcaption>cap &amp; x</figcaption></figure>c<img src="sha256:d2" alt="alt">')
    assert [(i["position"], i["kind"], i["text"], i["digest"], i["caption"]) for i in items] == [(0, "text", "T", None, None), (1, "text", "a b", None, None), (2, "media", None, "d1", "cap & x"), (3, "text", "c", None, None), (4, "media", None, "d2", "alt")]
    assert media.parse_sequence("") == []
    with pytest.raises(ValueError):
        media.read_image(b"P5\n24 1\n255\nshort")


def test_interleave_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "<p>a</p>", "mine", 5), (2, None, "yours", 6)], "page_id long, html string, text string, sequence int")
    got = {r["page_id"]: r for r in media.interleave(pages).collect()}
    assert got[1]["text"] == "mine" and [i["text"] for i in got[1]["sequence"]] == ["a"] and got[2]["sequence"] == []


# -- 3


def shingles(t):
    w = space_words(t or "")
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def test_ngram_components(docs, empty):
    sets = {i: shingles(t) for i, t in some_texts()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = by_id(ngrams.jaccard_components(docs))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == {i: (len(s), find(i)) for i, s in sets.items()}
    assert ngrams.jaccard_components(empty).count() == 0
    kept = ngrams.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in sets})


def test_altered_group(spark):
    """Copies of one text with their own changes: links and components by brute force, without all pairs as candidates."""
    g = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in g.sample(range(120), g.randrange(0, 6)):
            w[k] = f"z{g.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * len(sets[a] | sets[b]):
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = by_id(ngrams.jaccard_components(spark.createDataFrame(fixture(rows), SCHEMA)))
    assert {i: r["component_id"] for i, r in got.items()} == {i: find(i) for i in sets}


def test_documents_with_several_texts(spark):
    """A document with two texts links with what either links with."""
    g = random.Random(4)
    text = lambda: " ".join(f"w{g.randrange(10**6)}" for _ in range(40))
    a, b = text(), text()
    rows = [(1, a), (5, b), (5, a), (9, b), (7, text()), (7, None), (3, "x")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngrams.jaccard_components(spark.createDataFrame(fixture(rows), SCHEMA)).collect())
    assert got == [(1, 36, 1), (3, 1, 3), (5, 36, 1), (5, 36, 1), (7, 0, 7), (7, 36, 7), (9, 36, 1)]


@settings(deadline=None, max_examples=60)
@given(st.sets(st.integers(0, 40), min_size=1, max_size=30), st.sets(st.integers(0, 40), min_size=1, max_size=30))
def test_overlap_bound_never_low(a, b):
    x, y = (np.sort(np.array(sorted(s), np.uint64).astype(np.uint16) % 7) for s in (a, b))
    assert ngrams.overlap_bound(x, y) >= len(a & b)


# -- 4


def word_maker(seed):
    g = random.Random(seed)
    return lambda n: " ".join("".join(g.choice("abcdefghij") for _ in range(g.randrange(1, 8))) for _ in range(n))


def test_repeated_passages(spark, docs, empty):
    """Every passage of 51 words is caught, to its ends; passages of 30 words and single texts stay."""
    text = word_maker(5)
    passages = [text(51) for _ in range(40)]
    short = [text(30) for _ in range(20)]
    rows = []
    for k, p in enumerate(passages):
        rows += [(100 + k, f"{text(30)} {p} {text(25)}"), (200 + k, f"{text(40)} {p} {text(35)}"), (300 + k, text(120))]
    for k, p in enumerate(short):
        rows += [(400 + k, f"{text(30)} {p} {text(25)}"), (500 + k, f"{text(40)} {p} {text(35)}")]
    for parts in (1, 5):
        got = by_id(substrings.dedup_substrings(spark.createDataFrame(fixture(rows), SCHEMA).repartition(parts)))
        assert {k for k in got if got[k]["has_repeats"]} == {200 + k for k in range(40)}
        full = dict(rows)
        for k, p in enumerate(passages):
            r = got[200 + k]
            assert r["first_doc_ids"] == [100 + k]
            (span,) = r["spans"]
            cut = full[200 + k].encode()[span["begin"] : span["end"]].decode()
            assert p in cut and len(cut) <= len(p) + 4 and len(r["text"]) == len(full[200 + k]) - r["removed_bytes"]
    same = by_id(substrings.dedup_substrings(docs))
    assert same[22]["text"] == "" and same[23]["text"] == "" and same[10]["has_repeats"] and not same[0]["has_repeats"]
    assert substrings.dedup_substrings(empty).count() == 0


def repeated_words(texts, least=50):
    """For each text, its words that stand in a stretch of so many which has occurred before: in an earlier text, or earlier in it."""
    seen, out = set(), {}
    for i, t in sorted(texts.items()):
        w = t.split()
        hit = set()
        for k in range(len(w) - least + 1):
            window = tuple(w[k : k + least])
            if window in seen:
                hit.update(range(k, k + least))
            seen.add(window)
        out[i] = hit
    return out


def removed_words(text, spans):
    at, out = 0, set()
    raw = text.encode()
    for k, w in enumerate(text.split()):
        begin = raw.index(w.encode(), at)
        at = begin + len(w.encode())
        if any(s["begin"] <= begin and at <= s["end"] for s in spans):
            out.add(k)
    return out


def test_passages_by_brute_force(spark):
    """No word goes that isn't in a repeat of 50 words; passages of 51 words go whole, however short their words and whatever
    originals stand side by side."""
    g, text = random.Random(8), word_maker(9)
    tiny = lambda n: " ".join(g.choice("abcdefgh") + g.choice(["", "o", "i", "en"]) for _ in range(n))
    texts = {}
    thirty = [text(30) for _ in range(24)]
    for k, p in enumerate(thirty):
        texts[k] = f"{text(20)} {p} {text(20)}"
    for k in range(20):  # four passages of 30 words, each from another text: nothing here repeats 50 words
        texts[100 + k] = " ".join(g.sample(thirty, 4))
    passages = [(text if k % 2 else tiny)(51) for k in range(200)]
    for k, p in enumerate(passages):
        texts[1000 + k] = f"{text(9)} {p} {text(9)}"
        texts[3000 + k] = f"{text(12)} {p} {g.choice(thirty)} {text(7)}"
    pool = [text(n) for n in (60, 80, 55, 70)]
    for k in range(30):
        texts[5000 + k] = " ".join(g.choice([*pool, text(20), text(9), g.choice(thirty)]) for _ in range(4))
    texts[6000] = f"{pool[0]} {text(5)} {pool[0]}"
    got = by_id(substrings.dedup_substrings(spark.createDataFrame(fixture(texts.items()), SCHEMA).repartition(3)))
    want = repeated_words(texts)
    gone = {i: removed_words(texts[i], r["spans"]) for i, r in got.items()}
    assert all(gone[i] <= want[i] for i in texts)
    assert all(want[3000 + k] == gone[3000 + k] and len(gone[3000 + k]) >= 51 for k in range(200))
    assert not any(got[100 + k]["has_repeats"] for k in range(20))
    assert sum(len(x) for x in gone.values()) >= 0.97 * sum(len(x) for x in want.values())


def test_ids_with_several_texts(spark):
    """Texts under one id are documents of their own; equal rows are one. Nothing is cut by another text's places."""
    text = word_maker(3)
    p, other, third = text(60), text(70), "é" * 30 + " " + text(40)
    rows = [(1, f"{p} {other}"), (2, third), (2, f"{text(5)} {p} {text(5)}"), (2, third), (None, p), (None, p)]
    got = substrings.dedup_substrings(spark.createDataFrame(fixture(rows), SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 0, r["has_repeats"]) for r in got) == [(0, False), (0, False), (1, False), (2, False), (2, False), (2, True)]
    assert sum(r["text"] == third for r in got) == 2


def test_cuts_resist_insertions():
    g = random.Random(2)
    a = "".join(g.choice("abcdefghijklmnop ") for _ in range(5000))
    chunks = lambda t: [t.encode()[x:y] for x, y in itertools.pairwise([0, *substrings.cut_places(np.frombuffer(t.encode(), np.uint8)).tolist()])]
    one, two = chunks(a), chunks(a[:2000] + "inserted" + a[2000:])
    assert b"".join(one) == a.encode()
    assert len(set(one) - set(two)) <= 3
    for t in ("é" * 3000, "x" * 5000, "=-" * 900, "日本" * 400):
        assert b"".join(chunks(t)) == t.encode() and max(map(len, chunks(t))) <= substrings.MAX_CHUNK + 3
        assert all(c.decode() for c in chunks(t))


@settings(deadline=None, max_examples=100)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=60), st.integers(1, 20))
def test_over_windows(x, wide):
    if len(x) >= wide:
        got = substrings._over_windows(np.array(x), wide, np.minimum)
        assert got.tolist() == [min(x[k : k + wide]) for k in range(len(x) - wide + 1)]


# -- 5


def test_line_dedup(spark, docs, empty):
    g = random.Random(9)
    text = lambda n: "".join(g.choice("abcdef ") for _ in range(n)).strip() + "x"
    pool = [text(n) for n in (12, 15, 30, 33, 34, 60, 61, 100) for _ in range(3)]
    for p in list(pool):
        k = g.randrange(len(p))
        pool += [p[:k] + p[k + 1 :], p[:k] + "q" + p[k:], p[:k] + "#" + p[k + 1 :]]
    rows = [(i, "\n".join([g.choice(pool) for _ in range(6)] + ["", "ab", "ac"])) for i in range(40)] + [(50, None), (51, "")]
    first = {}
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line.strip(), (i, k))
    near = {a for a in first for b in first if a != b and min(len(a), len(b)) >= lines.MIN_FUZZY and first[b] < first[a] and lines.within_one(a, b)}
    want = {i: [k for k, line in enumerate((t or "").split("\n")) if line.strip() and (line.strip() in near or first[line.strip()] != (i, k))] for i, t in rows}
    got = by_id(lines.dedup_lines(spark.createDataFrame(fixture(rows), SCHEMA).repartition(4)))
    assert {i: r["removed"] or [] for i, r in got.items()} == want
    assert got[50]["text"] is None and got[51]["text"] == "" and lines.dedup_lines(empty).count() == 0
    assert set(docs.columns) < set(lines.dedup_lines(docs).columns)


@pytest.mark.parametrize("at", [0, 5, 15, 16, 17, 31, 32])
def test_near_lines_on_both_sides_of_short(spark, at):
    base = "".join(chr(97 + k * 7 % 26) for k in range(lines.SHORT))
    other = "".join(chr(97 + k * 11 % 26) for k in range(lines.SHORT + 1))
    rows = [(1, base), (2, base[:at] + "#" + base[at:]), (3, other), (4, other[:at] + other[at + 1 :])]
    got = by_id(lines.dedup_lines(spark.createDataFrame(fixture(rows), SCHEMA)))
    assert {i for i, r in got.items() if r["removed"]} == {2, 4}


def test_keys_of_variants():
    """Equal keys for equal variants, and only for those, whatever part of a line they come from."""
    g, p = random.Random(1), lines.powers(12345)
    seen = {}
    for _ in range(300):
        t = "".join(g.choice("abé😀") for _ in range(g.randrange(2, 9)))
        a = g.randrange(0, len(t) - 1)
        b = g.randrange(a + 1, len(t) + 1)
        part = t[a:b]
        one = np.array([1])
        keys = lines.Sums(p, ["before", t, "after"]).cuts(one, one * a, one * b, one * 7)[0].tolist()
        for v, k in zip([part[:i] + part[i + 1 :] for i in range(len(part))] + [part], keys, strict=True):
            assert seen.setdefault(v, k) == k
    assert len(set(seen.values())) == len(seen)
    for t in ("abcdefgh", "abcdefghi"):
        keys, begin, end = (x[1] for x in lines.Sums(p, ["x", t]).halves(np.arange(2)))
        assert len(set(keys.tolist())) == 4 and [t[a:b] for a, b in zip(begin, end, strict=True)] in (["efgh", "abcd", "defgh", "abcde"], ["efghi", "abcde", "efghi", "abcde"])


def test_lines_of_ids_with_several_texts(spark):
    """A row's lines are judged by its own text; rows without id and clashing names are left alone."""
    rows = [(1, "a line of its own"), (2, "first here and now\nsecond here and now"), (2, "quite another text"), (3, "first here and now"), (None, "first here and now")]
    d = spark.createDataFrame([(i, t, "x", True, 5) for i, t in rows], "doc_id long, text string, _id string, near boolean, removed int")
    got = lines.dedup_lines(d, "gone").collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["gone"]) for r in got if r["gone"]) == [(3, "", [0])]
    assert len(got) == 5 and all((r["_id"], r["near"], r["removed"]) == ("x", True, 5) for r in got)
    assert set(lines.dedup_lines(d).columns) == set(d.columns)


def test_large_half_groups_are_refined(spark):
    half = "shared first half of many lines "
    rows = [(i, half + f"{'tail' * 6} number {chr(97 + i % 26)}{i:03d}") for i in range(120)]
    got = by_id(lines.dedup_lines(spark.createDataFrame(fixture(rows), SCHEMA)))
    want = {i for i, t in rows if any(j < i and lines.within_one(t, u) for j, u in rows)}
    assert {i for i, r in got.items() if r["removed"]} == want


@settings(deadline=None, max_examples=200)
@given(st.text("ab", max_size=7), st.text("ab", max_size=7))
def test_within_one(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    assert lines.within_one(a, b) == (d[-1] <= 1)


# -- 6


def test_url_rules_and_verdicts(spark):
    made = ["http://a.example.com/en/7x", "HTTP://A.COM/en/1", "https://x.net/de/8", "http://b.example.net/de/88?q#f", "http://org/es/", "mailto:x", None, "http://netx/de/1", "http://q.com/fr/1#://", ""]
    made += [f"http://h{k}.example.com/en/{1 + k % 6}" for k in range(40)] + [f"http://h{k}.example.net/de/{k % 7}" for k in range(40)]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge_urls(pages).collect()}
    assert [got[k]["rule"] for k in range(10)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None]
    assert [got[k]["verdict"] for k in range(5)] == ["allow", "block", "allow", "block", "block"]
    assert (got[3]["host"], got[3]["path"]) == ("b.example.net", "/de/88") and (got[5]["host"], got[6]["path"]) == ("", "")
    assert urls.judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages.filter("page_id = 8")).collect()} == {"allow"}


def test_url_scores_by_hand(spark):
    good, bad, order = ["aab", "ab"], ["bba"], 2
    lab = spark.createDataFrame([(u, True, 1) for u in good] + [(u, False, 1) for u in bad], "url string, good boolean, weight int")
    want = {}
    for u in ("aab", "bb", "zz"):
        total = 0.0
        for side, sign in ((good, 1), (bad, -1)):
            grams = [("\x02" * order + x + "\x03")[k : k + order + 1] for x in side for k in range(len(x) + 1)]
            for k in range(len(u) + 1):
                w, p = ("\x02" * order + u + "\x03")[k : k + order + 1], 1 / urls.ALPHABET
                for n in range(order + 1):
                    ctx = w[order - n : order]
                    seen = [x[-1] for x in grams if x[order - n : order] == ctx]
                    if seen:
                        t = len(set(seen))
                        p = (seen.count(w[-1]) + t * p) / (len(seen) + t)
                total += sign * math.log10(p)
        want[u] = total / (len(u) + 1)
    got = {r["url"]: r["score"] for r in urls.url_scores(spark.createDataFrame([(u,) for u in want], "url string"), lab, order).collect()}
    assert all(math.isclose(got[u], want[u], abs_tol=1e-7) for u in want)


# -- 7


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_coding_round_trip(v):
    control, data = encode.encode_values(np.array(v, np.uint32))
    assert encode.decode_values(control, data, len(v)).tolist() == v


def test_token_files(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    files, ranks = encode.write_id_files(docs, path, 2, file_bytes=2000)
    assert files.count() > 3
    got, t, at = by_id(encode.read_id_files(files, ranks)), Tokenizer.from_file(path), 0
    for i, text in sorted(some_texts()):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[i]["ids"] == ids and (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    files, ranks = encode.write_id_files(empty, path, 2)
    assert encode.read_id_files(files, ranks).count() == 0
    with pytest.raises(ValueError):
        encode.read_file(encode.write_file([1], np.array([1]), np.array([5]))[:-1])


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.characters(max_codepoint=0x24F) | st.sampled_from("<|> \n\x01the\u0301日\u2028\u200dİ"), max_size=25), max_size=6))
def test_ids_equal_the_tokenizers(texts):
    e = encode.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(x, e.wide).tolist() for x in e.encode(pa.array(texts, pa.string()))] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


# -- 8


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(st.integers(0, 40), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 5))
def test_bounds_are_optimal(hist, k):
    size, n = zip(*sorted(hist.items()), strict=True)
    cost = lambda b: sum(c * min(y for y in b if y >= x) for x, c in zip(size, n, strict=True))
    best = min(cost((*b, size[-1])) for r in range(min(k, len(size))) for b in itertools.combinations(size[:-1], r))
    got = packing.optimal_bounds(list(size), list(n), k)
    assert len(got) <= k and cost(got) == best


def test_packing(docs, empty):
    rows = packing.pack(docs, n_buckets=4, token_budget=200).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in some_texts())
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["batch"], r["slot"])), key=lambda r: (r["bucket"], r["batch"])):
        g = list(g)
        assert [r["slot"] for r in g] == list(range(len(g))) and all(r["n_tokens"] <= r["bucket_len"] for r in g)
        assert len(g) == 1 or len(g) * g[0]["bucket_len"] <= 200
    assert packing.pack(empty).count() == 0


def test_long_documents_have_exact_bounds(spark):
    d = spark.createDataFrame(fixture([(1, "w " * 5001), (2, "w " * 9003), (3, "w")]), SCHEMA)
    assert {r["doc_id"]: (r["bucket_len"], r["pad"]) for r in packing.pack(d).collect()} == {1: (5001, 0), 2: (9003, 0), 3: (1, 0)}


# -- 9


def test_brown_counts(docs, empty):
    rows = some_texts()
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = collections.Counter(w for _, t in train for w in space_words(t or ""))
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = by_id(brown.score_texts(docs))
    for i, t in rows:
        w, r = space_words(t or ""), got[i]
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
    assert brown.score_texts(empty).count() == 0


def test_exchange_finds_classes():
    """Words that alternate between two sets must end in two classes."""
    n = np.zeros((1 + 8 + brown.SHAPES,) * 2)
    n[1:5, 5:9] = 10
    n[5:9, 1:5] = 10
    of = brown.exchange(n, 8, classes=2)
    assert len(set(of[1:5])) == 1 and len(set(of[5:9])) == 1 and of[1] != of[5]


def test_best_classes_is_the_exchange_gain():
    """For words without a class yet, and whose neighbours are others, the batch finds what the single exchange finds."""
    g, classes = np.random.default_rng(1).integers(0, 40, (1 + 5 + brown.SHAPES,) * 2).astype(float), 5
    total, k, ctx, n, want = len(g), [], [], [], []
    for w in range(60):
        r = np.random.default_rng(w)
        out, into = r.integers(0, 30, total) * (r.random(total) < 0.4), r.integers(0, 30, total) * (r.random(total) < 0.4)
        out[1:6] = into[1:6] = 0
        out[0] += 1
        codes = [*np.flatnonzero(into), *(total + np.flatnonzero(out))]
        k.append(len(codes))
        ctx += codes
        n += [*into[into > 0], *out[out > 0]]
        mine = g.copy()
        brown.put(mine, 6, out, into, 0, 1)
        want.append(brown.best_class(mine, 6, out.astype(float), into.astype(float), 0.0, classes))
    got = brown.best_classes(g, classes, np.full(60, 6), np.array(k), np.array(ctx), np.array(n))
    assert got.tolist() == want


@pytest.mark.parametrize("lexicon", [200_000, 12])
def test_all_frequent_words_have_classes(spark, monkeypatch, lexicon):
    """Far more words than seeds, with the class of each; scores by hand from the classes, also beyond the lexicon."""
    monkeypatch.setattr(brown, "LEXICON", lexicon)
    monkeypatch.setattr(brown, "SEEDS", 10)
    g = random.Random(4)
    left, right = [f"l{chr(97 + k)}" for k in range(20)], [f"r{chr(97 + k)}" for k in range(20)]
    rows = [(k, " ".join(g.choice(left) + " " + g.choice(right) for _ in range(12)) + f" rare{k} odd.") for k in range(60)]
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    docs = brown.docs_text(spark.createDataFrame(fixture(rows), SCHEMA)).withColumn("held_out", ~F.col("doc_id").isin([i for i, _ in train]))
    fit = brown.Fitted(docs)
    c = collections.Counter(w for _, t in train for w in t.split())
    words = sorted({w for _, t in rows for w in t.split()})
    key = dict(zip(words, brown.word_keys(pa.array(words))[0].tolist(), strict=True))
    shape = lambda w: (key[w] & 3) - 1
    assert [shape(w) for w in ("la", "odd.", "rare0")] == [0, 1, 2]
    assert {r["key"]: r["n"] for r in fit.vocabulary.collect()} == {key[w]: n for w, n in c.items()}
    of = dict(zip(fit.lexicon.keys.tolist(), fit.lexicon.of[brown.FIRST :].tolist(), strict=True))
    of |= {r["key"]: r["cls"] for r in fit.outside.collect()}
    classes = fit.lexicon.classes
    assert len(of) == sum(n >= brown.MIN_COUNT for n in c.values()) and all(1 <= k <= classes for k in of.values())
    assert not {of[key[w]] for w in left} & {of[key[w]] for w in right}
    cls = lambda w: of.get(key[w], classes + 1 + shape(w))
    total = classes + 1 + brown.SHAPES
    n = np.zeros((total, total))
    for _, t in train:
        k = [0, *map(cls, t.split()), 0]
        np.add.at(n, (k[:-1], k[1:]), 1)
    assert (n == fit.g).all()
    tokens, prior = n.sum(0), (n.sum(0) + 1) / (n.sum() + total)
    unseen = collections.Counter()
    for w, k in c.items():
        if k < brown.MIN_COUNT:
            unseen[shape(w)] += k + 1
    got = by_id(brown.scored_by(fit))
    for i, t in rows:
        k = [0, *map(cls, t.split()), 0]
        want = sum(math.log10((n[a, b] + brown.SMOOTH * prior[b]) / (n[a].sum() + brown.SMOOTH)) for a, b in itertools.pairwise(k))
        want += sum(math.log10(c[w] / tokens[cls(w)]) if cls(w) <= classes else math.log10((c[w] + 1) / (unseen[shape(w)] + 1)) for w in t.split())
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9)
        assert math.isclose(got[i]["perplexity"], 10 ** (-want / (len(k) - 1)), rel_tol=1e-9)


def test_only_held_out_documents(spark):
    """Without training documents no word is known."""
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = by_id(brown.score_texts(spark.createDataFrame(fixture([(i, "some words here") for i in held]), SCHEMA)))
    assert all((r["n_known"], r["train_tokens"], r["held_out"]) == (0, 0, True) and r["score"] <= 0 for r in got.values()) and len(got) == 3


# -- 10


@pytest.mark.parametrize("block_words", [2_000_000, 10])
def test_contamination(spark, docs, empty, block_words):
    texts = dict(some_texts())
    items = [(1, texts[0][:120]), (2, "one, TWO"), (3, None), (4, ""), (5, "never seen words at all in any of the documents here okay fine"), (6, texts[2]), (6, texts[2])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, spans string")
    win = collections.defaultdict(set)
    for i, t in items:
        w = letter_words(t or "")
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            if n:
                win[tuple(w[k : k + n])].add(str(i))
    got = by_id(decontaminate.contamination(docs, bench, block_words=block_words))
    for i, t in texts.items():
        w, hit, its = letter_words(t or ""), set(), set()
        for key, owners in win.items():
            for k in range(len(w) - len(key) + 1):
                if tuple(w[k : k + len(key)]) == key:
                    hit.update(range(k, k + len(key)))
                    its |= owners
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(its), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(its)).encode()).hexdigest()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.remove_contaminated(docs, bench).columns == docs.columns


def test_items_without_an_id(spark, docs):
    """Their windows hit words; they count as one item and stay out of the hash."""
    text = dict(some_texts())[0]
    bench = spark.createDataFrame([(None, text[:150]), (7, text[:150]), (None, "one two")], "item_id long, text string")
    got = by_id(decontaminate.contamination(docs, bench))
    assert got[0]["contaminated"] and got[0]["n_items"] == 2 and got[0]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    assert got[25]["n_hit"] == 2 and got[25]["n_items"] == 1 and got[25]["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_words_by_the_given_classes():
    for t in ("A-b_c9 Éx 'q'\x7f!z", "", "ß—ü 1.5"):
        assert [w.decode() for w in letter_words(t)] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


@settings(deadline=None, max_examples=150)
@given(st.lists(st.text(st.characters(max_codepoint=0x17F) | st.sampled_from(" \t\x00\x0bab"), max_size=30), max_size=6))
def test_hashed_words(texts):
    w, plain = HashedWords(pa.array(texts, pa.string())), [space_words(t) for t in texts]
    flat = [x for ws in plain for x in ws]
    assert w.counts.tolist() == [len(x) for x in plain]
    assert len(set(zip(flat, w.hashes.tolist(), strict=True))) == len(set(flat)) == len(set(w.hashes.tolist()))
    assert [w.raw[a:b].tobytes().lower() for a, b in zip(w.starts, w.stops(), strict=True)] == [x.lower() for x in flat]


def thue_morse(n):
    """Two words of n letters that a polynomial modulo a power of two can't tell apart, whatever its base."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_made_to_collide(spark, n):
    one, two = thue_morse(n)
    assert len(set(HashedWords(pa.array([f"{one} {two} {one}"])).hashes.tolist())) == 2
    p = lines.powers(99)
    assert not set.intersection(*map(set, lines.Sums(p, [one, two]).halves(np.arange(2))[0].tolist()))
    d = spark.createDataFrame(fixture([(1, f"one two three four {one}"), (2, f"one two three four {two}"), (3, f"one two three four {one}")]), SCHEMA)
    assert {i: r["component_id"] for i, r in by_id(ngrams.jaccard_components(d)).items()} == {1: 1, 2: 2, 3: 1}
    encoder = encode.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    plain = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in (one, two)]
    assert [np.frombuffer(x, encoder.wide).tolist() for x in encoder.encode(pa.array([one, two]))] == plain


@settings(deadline=None, max_examples=25)
@given(st.lists(st.text("ab", min_size=1, max_size=3000), max_size=5))
def test_long_words_of_two_letters(words):
    encoder = encode.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [np.frombuffer(x, encoder.wide).tolist() for x in encoder.encode(pa.array(words, pa.string()))]
    assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in words]


def test_lexicon_keeps_its_bound(spark, monkeypatch):
    """Words beyond a thousand occurrences don't stand in one class."""
    monkeypatch.setattr(brown, "LEXICON", 5)
    text = " ".join(f"w{k} " * (1001 + 40 * k) for k in range(40))
    fitted = brown.Fitted(spark.createDataFrame([(1, text, False)], "doc_id long, text string, held_out boolean"))
    assert 0 < len(fitted.lexicon.keys) <= 5


def test_spaced_letters_with_signs():
    ch = toxicity.Channel(word_model("idiot", "moron", "trash", "stupid", "such", "know", "you", "garbage", "a", "i"))
    assert "idiot" in ch.words("i d i o t!") and "idiot" in ch.words("you i d i o t.") and "idiot" in ch.words("i, d, i, o, t ...")
    assert "asshole" in ch.words("a s s h o l e") and "ass" in ch.words("a s s")


@pytest.mark.parametrize("name", ["__go", "__bad"])
def test_filters_keep_clashing_names(spark, name):
    rows = [(1, "a b c d e f g h i j k l", 7), (2, "a b c d e f g h i j k l", 8), (3, "other words altogether", 9)]
    d = spark.createDataFrame(rows, f"doc_id long, text string, {name} int")
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("x", "other words altogether")], "item_id string, text string")
    assert {r[name] for r in ngrams.keep_one_of_each(d).collect()} == {7, 9}
    assert {r[name] for r in decontaminate.remove_contaminated(d, bench).collect()} == {7, 8}
    assert {r[name] for r in toxicity.drop_toxic(d, labels).collect()} == {7, 8, 9}


# -- The pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in some_texts() if r[1]]
    d = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, dict(rows)[4][:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == d.columns, name
    left = {r["doc_id"] for r in out.collect()}
    assert 0 in left and 4 not in left and not left & {10, 11, 12}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select(F.col("doc_id")).collect()} == left
