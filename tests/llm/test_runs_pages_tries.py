"""Periodic runs, page extraction and the conversation trie against brute force, with the cases that break things."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from precinct.llm import extract, periods, trie

# -- Periodic runs


def plain_runs(t, least=6, times=4):
    found = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            s = i
            while i + q < len(t) and t[i] == t[i + q]:
                i += 1
            if i - s + q >= max(least, times * q):
                found.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, q, n) for (s, n), q in found.items())


def some_words(g, kind):
    if kind == 0:
        return [g.randint(0, 1) for _ in range(g.randint(0, 60))]
    if kind == 1:
        p = [g.randint(0, 3) for _ in range(g.randint(1, 9))]
        return [g.randint(0, 3) for _ in range(5)] + p * g.randint(1, 8) + p[: g.randint(0, len(p))] + [g.randint(0, 3) for _ in range(4)]
    if kind == 2:
        return [0] * g.randint(0, 40)
    if kind == 3:  # a period beyond the cover's modulus
        p = [g.randint(0, 500) for _ in range(g.randint(100, 400))]
        return [7, 8, 9, *p * 4, *p[:50], 3]
    return [g.randint(0, 30) for _ in range(300)]


def test_cover_has_every_difference():
    assert {(a - b) % periods.V for a in periods.COVER for b in periods.COVER} == set(range(periods.V))


@pytest.mark.parametrize("places", [1_000_000, 50])
def test_runs_by_brute_force(monkeypatch, places):
    monkeypatch.setattr(periods, "PLACES", places)
    g = random.Random(1)
    for _ in range(60):
        texts = [np.array(some_words(g, g.randint(0, 4)), np.int64) for _ in range(g.randint(1, 6))]
        of, s, n, q = periods.runs_of(texts)
        for k, t in enumerate(texts):
            assert sorted(zip(s[of == k].tolist(), q[of == k].tolist(), n[of == k].tolist(), strict=True)) == plain_runs(t.tolist())


def test_extensions_by_brute_force():
    g = np.random.default_rng(4)
    w = np.concatenate([np.tile(g.integers(0, 3, 700), 3), g.integers(0, 2, 300), [-2]])
    lce = periods.Lce(w)
    i, j = g.integers(0, len(w), 400), g.integers(0, len(w), 400)
    i, j = i[i != j], j[i != j]
    want = [next(k for k in itertools.count() if max(a, b) + k == len(w) or w[a + k] != w[b + k]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert lce(i, j).tolist() == want


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_periodic_runs_rows(spark):
    g = random.Random(5)
    vocab = "a b c dé  x the of".split(" ")
    texts = [" ".join(g.choice(vocab) for _ in range(g.randint(0, 90))) for _ in range(120)]
    rows = [(k, t, "clash", 1) for k, t in enumerate(texts)]
    rows += [(200, None, "x", 1), (201, "", "x", 1), (202, " \n\t ", "x", 1), (None, "z " * 9, "x", 1), (3, texts[3], "again", 2), (3, "other " * 7, "x", 3), (203, "y " * 30_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int").repartition(3)
    out = periods.with_digests(periods.periodic_runs(periods.with_planted_runs(df.select("doc_id", "text")))).collect()
    want = []
    for k, t, *_ in rows:
        w = planted(k, t)
        runs = plain_runs(w) if len(w) < 1000 else [(0, 1, len(w))]
        gone = {i for s, q, n in runs for i in range(s + q, s + n)}
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((k, len(runs), *top, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)
    kept = periods.periodic_runs(df)
    assert kept.columns == ["doc_id", "text", "n_words", "runs", "collapsed"] and kept.count() == len(rows)
    assert periods.periodic_runs(df.limit(0)).count() == 0


# -- Pages


def energy(costs, between, kept):
    return sum(max(-z if k else z, 0) for z, k in zip(costs, kept, strict=True)) + sum(c for (a, b), c in between.items() if kept[a] != kept[b])


def test_cut_is_least_and_keeps_most():
    g = random.Random(2)
    for _ in range(800):
        n = g.randint(0, 9)
        costs = [g.randint(-6, 6) for _ in range(n)]
        between = {(a, b): g.randint(1, 5) for a in range(n) for b in range(a + 1, n) if g.random() < 0.4}
        every = list(itertools.product([False, True], repeat=n))
        least = min(energy(costs, between, x) for x in every)
        assert tuple(extract.minimum_cut(costs, between)) == max((x for x in every if energy(costs, between, x) == least), key=sum)


ARTICLE = """<html><body class="has-sidebar"><div id="cookie-notice"><p>We use cookies to make this better. Accept them all please, thank you very much.</p></div>
<header><h1>My Site</h1><p>Best site around</p></header><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul>
<div class="layout"><main><header class="entry-header"><h1>Title &amp; more</h1><p class="byline">By A</p></header><p>First para<br>line two &nbsp; with <b>bold. <p>Second para.
<div class="ad-slot"><p>Buy now! Great stuff for everyone, with long sentences that look like content in every way.</p></div><ul><li>one</li><li>two<li>three</ul><table><tr><td>a<td>b</table>
<form><label>Mail</label><input><button>Send</button></form><p>Third &lt;p&gt;&#233;.</p><script>var t="</p><p>no";</script><style>p{}</style><!-- <p>nor this</p> -->
<section id="comments"><h2>Comments</h2><article><p>Nice article, I love it so much that I wrote this long comment here.</p></article></section></main>
<aside><p>Related reading: something long enough to look like content, surely.</p></aside></div><footer>&copy; 2024 Foo</footer></body></html>"""
SOUP = f"""<body><div><a href=1>Home</a> | <a href=2>Shop</a></div><div><div>A headline</div><div>{"Word after word this text goes on until it has said it all. " * 3}</div>
<div>Short one.</div><div>{"Another long text that tells a story about something to somebody in many words. " * 2}</div></div><div>Copyright 2020 by Foo</div></body>"""


def test_main_blocks():
    assert extract.main_blocks(ARTICLE) == ["Title & more", "By A", "First para line two with bold.", "Second para.", "one", "two", "three", "a", "b", "Third <p>é."]
    soup = extract.main_blocks(SOUP)
    assert soup[-2] == "Short one." and len(soup) >= 3 and not any("Home" in x or "Copyright" in x for x in soup)
    form = "<form><div class=menu>Home</div><article><p>Inside a form.</p></article></form>"
    assert extract.main_blocks(form) == ["Inside a form."]
    for nothing in ("", " ", "<", "<!-- x", "<script>var a='<p>", "<nav>x", "</p></div>", "<p>"):
        assert extract.main_blocks(nothing) == []
    assert extract.main_blocks("<div>" * 20_000 + "<article>x</article>" + "</div>" * 20_000) == ["x"]
    assert len(extract.main_blocks("<article>" + "<p>Some text.</p><div class=ad>buy</div>" * 3000)) == 3000


def test_extract_rows(spark):
    rows = [(1, "u", ARTICLE, "clash", 5), (1, "u", ARTICLE, "clash", 5), (None, None, None, None, None), (2, "v", "", "c", 1), (3, "w", "<article>" + "<p>ab cd.</p>" * 50_000, "c", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=repr)
    text = "\n\n".join(extract.main_blocks(ARTICLE))
    many = "\n\n".join(["ab cd."] * 50_000)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", many, len(many))], key=repr)
    assert extract.extract(df.limit(0)).count() == 0


# -- Conversations


def ordered(rows):
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def plain_trie(convs):
    members = collections.defaultdict(set)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].add(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    out = []
    for s, m in members.items():
        below = [u for u in members if u[: len(s)] == s]
        saved = sum((len(members[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in below if u)
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids[s], sum(kids[u] == 0 for u in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_conversations():
    g = random.Random(3)
    rows = []
    for c in range(70):
        hot = g.random() < 0.4
        for t in range(g.choice([0, 1, 2, 3, 4, 5, 8, 9, 13])):
            text = f"the same {t}" if hot or g.random() < 0.6 else g.choice(["a b", "c", None, "  "])
            rows.append((c, t if g.random() < 0.95 else None, "user" if hot else g.choice(["user", None]), text, "clash", 1))
    return [*rows, (None, 1, "x", "y", "", 1), rows[5], (500, 0, "u", "long " * 50_000, "", 1), (-3, 1, "user", "the same 0", "", 2)]


TURNS = "conv_id long, turn long, role string, text string, number string, n int"


@pytest.mark.parametrize("block", [4, 3])
def test_trie_by_brute_force(spark, block):
    rows = some_conversations()
    own = ordered(rows)
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert sorted(map(tuple, trie.conversation_trie(df, block).collect()), key=repr) == plain_trie(own)


def test_rebuilt_trie_by_brute_force(spark):
    rows = some_conversations()
    own = ordered(rows)
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = {c: c - int(np.fmod(c, 20)) for c in own}
    rebuilt = {c: own.get(base[c], [])[: h[c]] + s[h[c] :] for c, s in own.items()}
    turns = trie.numbered_turns(spark.createDataFrame(rows, TURNS).repartition(3))
    assert sorted(map(tuple, trie.prefix_trie(*trie.with_shared_starts(turns)).collect()), key=repr) == plain_trie(rebuilt)


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([(None, 1, "a", "b", "", 1)], TURNS)
    assert trie.conversation_trie(none).count() == 0 and trie.conversation_trie(none.limit(0)).count() == 0
