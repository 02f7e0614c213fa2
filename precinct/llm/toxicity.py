"""Toxicity of noisy text: a noisy channel undone by Viterbi decoding, then a linear score of the restored words.

1. A character language model (interpolated order 3) is counted over all documents.
2. Words that may be disguised (digits and signs among or before letters, letters twice or more, single letters in a row)
   become lattices: a sign may stand for a letter, a run for one or two letters, a sign between single letters for
   nothing, a blank between them for nothing or for the end of a word. Viterbi decoding finds the likeliest reading under the language model and the channel's costs. All other
   words have one reading, themselves.
3. Features are the restored words and their first letters. Weights are smoothed log-odds between toxic and clean
   labelled documents (near copies share one document's weight), for the features that mark toxic ones strongly; the sum over a document's distinct features goes
   through a logistic curve fitted to the labelled documents.

Labels enter training only, and only those of documents that aren't held out. At most `max_train` labelled documents
are used, picked by a hash of doc_id if there are more. Null and empty texts have no features and get the curve's
value at zero; without labels of both kinds every score is near 0, or near 1 if all are toxic. Rows without doc_id
are scored and never learned from. Repeated labels of a document count once, toxic if any says so.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import hinted, materialize
from precinct.llm.common import HashedWords, docs_text, drawn_seed, map_batches, remainder, space_words

MAX_TRAIN = 200_000
FEATURES = 4096
PREFIXES = (4, 5, 6)
MIN_DOCS = 3
MIN_WEIGHT = 2.0
#: A document's sum of weights counts up to here: one strong word is evidence enough.
MOST_RAW = 10.0
#: A document's share of its group of copies, in whole units, so that sums don't depend on their order.
UNIT = 1_000_000
MIN_ASSOCIATION = 15.0  # twice the log-likelihood ratio

#: What a sign may stand for, and for each the channel's cost in nats. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h",
}
SWAP_COST, DROP_COST, RUN_COST = 0.5, 3.0, 0.7
#: Of reading a letter that stands twice as one: words often have two, so the model must much prefer one.
DOUBLE_COST = 2.0
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, SIZE = 26, 27, 28  # word edge; any other letter
CODE = {c: k for k, c in enumerate(LETTERS)}
_CODES = np.full(65536, EDGE, np.uint8)
for _c in range(65536):
    if chr(_c).isalpha():
        _CODES[_c] = CODE.get(chr(_c), OTHER)

#: Signs and digits that stand for letters beside a letter, a run of three, or digits and signs alone.
DISGUISED = re.compile(r"[^\W\d_][\d@$!|+(<€£*#]+[^\W\d_]|[\d@$!|+(<€£][^\W\d_]|[^\W\d_][\d@$|]|(.)\1\1|^[\d@$!|+]{3,}$")
#: A letter twice, and nothing else than letters: the word may have one letter more than it should.
DOUBLED = re.compile(r"([^\W\d_])\1")
#: Letters with a separator after each.
PARTED = re.compile(r"(?:[^\W_][.\-_*/~]){2,}[^\W_]")
#: So many one-letter words in a row are read as spaced letters.
SPACED = 3
#: Bytes that may stand behind a letter without being part of it.
_SIGN = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"')", np.uint8))
#: What is cut off a word's end, and off its start (where a sign may well stand for a letter).
_END, _START = ".,;:?!\"'()[]{}%&*#-_/\\~^`<>=+", ".,;:?\"'()[]{}%&*#-_/\\~^`>="


def count_trigrams(texts: list[str]) -> np.ndarray:
    """Counts of character triples, letters lower-cased and all else a word edge."""
    flat = np.frombuffer((" " + " ".join(texts).lower() + " ").encode("utf-16-le", "replace"), np.uint16)
    c = _CODES[flat].astype(np.int32)
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3) if len(c) > 2 else np.zeros(SIZE**3, np.int64)


def character_model(docs: DataFrame) -> np.ndarray:
    """Log-probabilities [a, b, c] of c after a, b. Its table has 28 cubed cells whatever the corpus."""

    def one(batch: pa.RecordBatch) -> dict:
        n = count_trigrams(batch["text"].to_pylist())
        seen = np.flatnonzero(n)
        return {"gram": seen, "n": n[seen]}

    rows = map_batches(docs.select("text"), one, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SIZE**3)
    for r in rows:
        n[r["gram"]] = r["n"]
    n = n.reshape(SIZE, SIZE, SIZE)
    one_ = (n.sum((0, 1)) + 1) / (n.sum() + SIZE)
    two = n.sum(0)
    p2 = (two + 5 * one_) / (two.sum(1, keepdims=True) + 5)
    return np.log((n + 5 * p2[None]) / (n.sum(2, keepdims=True) + 5))


class Channel:
    """Viterbi decoding of disguised words under a character model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def readings(self, text: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each place, what may stand there, with its cost. A blank between spaced letters may end a word or
        stand for nothing."""
        out, k = [], 0
        while k < len(text):
            c = text[k]
            run = 1
            while k + run < len(text) and text[k + run] == c:
                run += 1
            ways: list[tuple[str, float]] = []
            if c == " ":
                ways += [("", 0.0), (" ", 0.0)]
            elif c.isalpha():
                ways.append((c * min(run, 2), RUN_COST * (run > 2)))
                if run > 1:
                    ways.append((c, RUN_COST if run > 2 else DOUBLE_COST))
            else:
                for x in LEET.get(c, ""):
                    ways.append((x * min(run, 2), SWAP_COST))
                    if run > 1:
                        ways.append((x, SWAP_COST + RUN_COST))
                if not ways or not c.isalnum():
                    ways.append(("", DROP_COST))
            out.append(ways)
            k += run
        return out

    def decode(self, text: str) -> str:
        """The likeliest reading. A state is the last two characters; each keeps its best path."""
        code = CODE.get
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}
        for ways in self.readings(text):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for letters, price in ways:
                    x, y, total, way = a, b, cost + price, path
                    for c in letters:
                        z = EDGE if c == " " else code(c, OTHER)
                        total -= self.model[x][y][z]
                        x, y, way = y, z, (way, c)
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, way)
            states = new
        _, path = min(((c - self.model[a][b][EDGE], p) for (a, b), (c, p) in states.items()), key=lambda s: s[0])
        out = []
        while path:
            path, c = path
            out.append(c)
        return "".join(reversed(out))

    def cost(self, letters: str) -> float:
        """Of a word as it stands, under the character model."""
        x = y = EDGE
        total = 0.0
        for c in letters:
            z = CODE.get(c, OTHER)
            total -= self.model[x][y][z]
            x, y = y, z
        return total - self.model[x][y][EDGE]

    def undoubled(self, word: str) -> str:
        """What `decode` gives for a word of letters with one run of two: its two readings side by side."""
        at = DOUBLED.search(word).start()
        short = word[:at] + word[at + 1 :]
        if DOUBLED.search(word, at + 1):
            return self.decode(word)
        return short if self.cost(short) + DOUBLE_COST < self.cost(word) else word

    def word(self, word: str) -> tuple[str, str]:
        """(the restored word, the word that its first letters are taken from): a letter dropped from a pair doesn't change those."""
        word = word.lower()
        core = word.rstrip(_END).lstrip(_START)
        if PARTED.fullmatch(core):
            core = self.decode(re.sub(r"[.\-_*/~]", "", core))
        elif DISGUISED.search(core):
            core = self.decode(core)
        elif DOUBLED.search(core):
            return self.undoubled(core), core
        return core, core

    def spaced(self, letters: list[str]) -> list[str]:
        """The words in a row of one-letter words: the blanks are arcs of the lattice, so decoding finds where words end. The row as
        one word is a reading of its own, since a word that the model doesn't know falls apart."""
        text = " ".join(x.lower() for x in letters)
        whole = text.replace(" ", "")
        return list(dict.fromkeys([*self.decode(text).split(), whole, self.word(whole)[0]]))

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text."""
        return {w for w, _ in self.restored(pa.array([text]))[0]} - {""}

    def restored(self, texts: pa.Array) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
        """(restored words as `word` gives them; for each document's distinct words: place in that list, document)."""
        w = HashedWords(texts, _TASK_SEED)
        _, one, which, doc = distinct_words(w)
        raw, stops = w.raw.tobytes(), w.stops()
        words = [self.word(raw[a:b].decode("utf-8", "replace")) for a, b in zip(w.starts[one].tolist(), stops[one].tolist(), strict=True)]
        more = [(x, d) for d, letters in spaced_letters(w) for x in self.spaced(letters)]
        which = np.concatenate([which, len(words) + np.arange(len(more))])
        return words + [(x, x) for x, _ in more], which, np.concatenate([doc, np.array([d for _, d in more], np.int64)])


def distinct_words(w: HashedWords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, a place of each, and for each document's distinct words: number of the hash, document)."""
    every, one, which = np.unique(w.hashes, return_index=True, return_inverse=True)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    pairs = np.unique(doc * max(len(every), 1) + which) if len(which) else np.empty(0, np.int64)
    doc, which = np.divmod(pairs, max(len(every), 1))
    return every, one, which, doc


def spaced_letters(w: HashedWords) -> Iterator[tuple[int, list[str]]]:
    """(document, letters) of every row of at least SPACED one-letter words; signs at a word's end don't count."""
    if not len(w.starts):
        return
    stops, lead = w.stops(), w.raw[w.starts]
    ends = stops.copy()
    for _ in range(3):  # as many signs as may stand behind a letter
        cut = (ends - w.starts > 1) & _SIGN[w.raw[ends - 1]]
        ends -= cut
    size = ends - w.starts
    single = (size == 1) & ((lead >= 65) & (lead <= 90) | (lead >= 97) & (lead <= 122) | (lead >= 48) & (lead <= 57) | np.isin(lead, np.frombuffer(b"@$!|+", np.uint8))) | (size == 2) & (lead >= 0xC3)
    doc = np.repeat(np.arange(len(w.counts)), w.counts)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], single, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        for k in np.split(np.arange(a, b), np.flatnonzero(np.diff(doc[a:b])) + 1):
            if len(k) >= SPACED:
                yield int(doc[k[0]]), [w.raw[w.starts[x] : ends[x]].tobytes().decode("utf-8", "replace") for x in k.tolist()]


#: Hashes of words stay in their process.
_TASK_SEED = drawn_seed()


class Known:
    """A memo of what words are worth, by their hash: sorted hashes and a number each; starts anew when full."""

    def __init__(self, most: int = 1_000_000):
        self.keys, self.numbers, self.most = np.empty(0, np.uint64), np.empty(0, np.int32), most

    def numbers_of(self, hashes: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Numbers of sorted distinct hashes; make gives those of the places in it that aren't known."""
        if len(self.keys) > self.most:
            self.keys, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int32)
        out = np.zeros(len(hashes), np.int32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            known = self.keys[at] == hashes
            out[known] = self.numbers[at[known]]
        else:
            known = np.zeros(len(hashes), bool)
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = make(new)
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.numbers = keys[order], np.concatenate([self.numbers, out[new]])[order]
        return out


def features(word: str, stem: str | None = None) -> list[str]:
    """Of a restored word: the word, and the first letters of stem (or of itself)."""
    stem = word if stem is None else stem
    return ["=" + word] + ["^" + stem[:k] for k in PREFIXES if len(stem) > k] if word else []


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_train: int = MAX_TRAIN) -> dict:
    """{feature: weight} and the curve: weights is bounded by FEATURES."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.filter(F.crc32(F.col("_id").cast("string")) % 5 != 0)
    n = marks.count()
    if n > max_train:
        marks = marks.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    known = docs.join(hinted(marks), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")

    def sketch(batch: pa.RecordBatch) -> dict:
        keys = [min((xxhash.xxh3_64_intdigest(w) >> 1 for w in set(space_words(t))), default=0) for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "key": keys}

    # Near copies mostly share the least hash of their words: each such group counts as one document.
    keys = materialize(map_batches(known, sketch, "doc_id long, toxic int, key long"), "toxic-keys")
    share = keys.groupBy("key", "toxic").agg(F.count("*").alias("n"))
    marks = materialize(keys.join(share, ["key", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(UNIT / F.col("n")).cast("long").alias("w")), "toxic-marks")
    known = docs.join(hinted(marks), "doc_id").select("text", "toxic", "w")

    def count(batch: pa.RecordBatch) -> dict:
        channel, number = _channel(model), {"": 0}
        words, which, doc = channel.restored(batch["text"])
        fids = [[number.setdefault(f, len(number)) for f in features(*x)] for x in words]
        per = [fids[k] for k in which.tolist()]
        size = np.fromiter(map(len, per), np.int64, count=len(per))
        flat = np.fromiter(chain.from_iterable(per), np.int64, count=int(size.sum()))
        # Each feature once a document; number 0 counts documents.
        pairs = np.unique(np.concatenate([np.repeat(doc, size) * len(number) + flat, np.arange(batch.num_rows) * len(number)]))
        d, f = np.divmod(pairs, len(number))
        weight, toxic = batch["w"].to_numpy()[d], batch["toxic"].to_numpy()[d] > 0
        add = lambda m: np.bincount(f[m], weights=weight[m], minlength=len(number)).astype(np.int64)
        return {"feature": list(number), "clean": add(~toxic), "toxic": add(toxic)}

    counts = map_batches(known, count, "feature string, clean long, toxic long").groupBy("feature").agg((F.sum("clean") / UNIT).alias("c"), (F.sum("toxic") / UNIT).alias("t"))
    counts = materialize(counts.filter(F.expr(f"t >= {MIN_DOCS} or feature = ''")), "toxic-features")
    total = counts.filter("feature = ''").first()
    clean, toxic = (total["c"], total["t"]) if total else (0, 0)
    if not clean or not toxic:
        return {"weights": {}, "slope": 0.0, "at": math.log(toxic / clean) if clean and toxic else (-20.0 if not toxic else 20.0)}
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    part = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) * (clean + toxic) / ((F.col("c") + F.col("t")) * of))).otherwise(0.0)
    strength = 2 * (part("t", toxic) + part("c", clean))
    picked = (
        counts.filter("feature <> ''").select("feature", weight.alias("w"), strength.alias("g"))
        .filter(f"w >= {MIN_WEIGHT} and g >= {MIN_ASSOCIATION}").orderBy(F.desc("g"), "feature").limit(FEATURES).collect()
    )
    weights = {r["feature"]: r["w"] for r in picked}
    found = _raw_scores(known, model, weights, "toxic int, w long").groupBy(F.round("raw", 1).alias("x"), "toxic").agg((F.sum("w") / UNIT).alias("n")).collect()
    slope, at = fit_curve([(r["x"], r["toxic"], r["n"]) for r in found])
    return {"weights": weights, "slope": slope, "at": at}


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(slope, intercept) of the logistic curve, by Newton steps with a little shrinkage. points is a histogram."""
    x, y, n = (np.array([p[k] for p in points], float) for k in range(3))
    wide = np.stack([x, np.ones_like(x)], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(wide @ b, -30, 30)))
        step = np.linalg.solve(wide.T @ (wide * (n * p * (1 - p))[:, None]) + 0.01 * np.eye(2), wide.T @ (n * (y - p)) - 0.01 * b)
        b += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return max(float(b[0]), 0.0), float(b[1])


def _raw_scores(docs: DataFrame, model: np.ndarray, weights: dict[str, float], extra: str) -> DataFrame:
    names_ = [part.split()[0] for part in extra.split(",")]

    def one(batch: pa.RecordBatch) -> dict:
        channel, known, worth = _memo(model, weights)
        w = HashedWords(batch["text"], _TASK_SEED)
        every, at, which, doc = distinct_words(w)
        raw, stops = w.raw.tobytes(), w.stops()

        def number(word: tuple[str, str]) -> int:
            return worth.setdefault(tuple(f for f in features(*word) if f in weights), len(worth))

        def made(places: np.ndarray) -> np.ndarray:
            return np.array([number(channel.word(raw[w.starts[k] : stops[k]].decode("utf-8", "replace"))) for k in at[places].tolist()], np.int32)

        hits = known.numbers_of(every, made)[which]
        found: dict[int, set] = {}
        names = list(worth)
        for d, k in zip(doc[hits > 0].tolist(), hits[hits > 0].tolist(), strict=True):
            found.setdefault(d, set()).update(names[k])
        for d, letters in spaced_letters(w):
            for x in channel.spaced(letters):
                found.setdefault(d, set()).update(f for f in features(x) if f in weights)
        raws = np.zeros(batch.num_rows)
        for d, mine in found.items():
            raws[d] = min(math.fsum(weights[f] for f in mine), MOST_RAW)
        return {n: batch[n] for n in names_} | {"raw": raws}

    return map_batches(docs.select(*names_, "text"), one, f"{extra}, raw double")


_MEMO: dict[bytes, tuple] = {}


def _channel(model: np.ndarray) -> Channel:
    return Channel(model)


def _memo(model: np.ndarray, weights: dict[str, float]) -> tuple[Channel, Known, dict]:
    """Channel, memo and features of the words in it, once a worker and model, so that words are remembered between batches."""
    key = xxhash.xxh3_128_digest(model.tobytes() + repr(sorted(weights.items())).encode("utf-8"))
    if key not in _MEMO:
        _MEMO.clear()
        _MEMO[key] = (Channel(model), Known(), {(): 0})
    return _MEMO[key]


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    docs = docs_text(docs)
    model = character_model(docs)
    made = train(docs, labels.select("doc_id", "toxic"), model, max_train)
    raw = _raw_scores(docs, model, made["weights"], "doc_id long")
    score = 1 / (1 + F.exp(-(F.col("raw") * made["slope"] + made["at"])))
    return raw.select("doc_id", (remainder(5) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic; all columns are kept."""
    go = materialize(score_toxicity(docs, labels).filter("predicted = 1").select(F.col("doc_id").alias("__go")).distinct(), "toxic-documents")
    return docs.join(hinted(go), docs["doc_id"].cast("long") == go["__go"], "left_anti")
