"""Periodic runs of words: all maximal stretches that repeat a shorter one, and texts without the repeats.

A run is a stretch of words with smallest period q (words q apart are identical) and at least max(`LEAST`, `TIMES` * q) words that no
neighbouring word extends. Its repeats are the words after its first q.

For a period q the words that equal the word q places on form stretches; a run's has (TIMES - 1) * q words or more, so the multiples
of (TIMES - 1) * q among the places hit every run. Over all q these are n log n / 3 places (a harmonic sum). From each place that
matches, the stretch is measured both ways by longest common extensions.

Extensions (`Lce`) sort only the suffixes that begin at places of a difference cover modulo `V`: for any two places some shift below V
brings both into the cover. So a few words are compared until both are in step with sampled suffixes, and the rest is a range
minimum over their common blocks, from a sparse table. One structure serves all texts of a batch that have anything to
measure; a separator that occurs once stands between texts, so no extension leaves its text.

Words are bytes between ASCII white space, told apart exactly. Null and empty texts have no words and no runs. Every row is taken by
itself, so repeated rows, ties and null ids give a row each; an empty table gives none. A text must fit in a task's memory
(about 200 bytes a word); other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from precinct.llm.common import ARROW_BYTES, map_batches

LEAST, TIMES = 6, 4
#: A difference cover: every number modulo V is a difference of two of these (a perfect difference set, a fixed value).
V = 133
COVER = np.array([0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109])
#: For each difference d modulo V, a member x of the cover for which x + d is one too.
SHIFT = np.full(V, -1)
for _x in COVER:
    SHIFT[(COVER - _x) % V] = _x
#: Words compared before a place counts as worth measuring.
PEEK = 8
#: Places looked at together.
PLACES = 1_000_000


def matching(w: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each pair, how many words from i on equal those from j on, counted up to `most`."""
    out = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        at = out[live]
        live = live[w[i[live] + at] == w[j[live] + at]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


class Lce:
    """Longest common extensions to the right between places of w. The last word of w occurs once."""

    def __init__(self, w: np.ndarray):
        self.w = w = w.astype(np.int64)
        n = len(w)
        self.at = np.concatenate([np.arange(r, n, V) for r in COVER])  # blocks that follow each other stand side by side
        self.index = np.full(n, -1, np.int64)
        self.index[self.at] = np.arange(len(self.at))
        blocks = np.lib.stride_tricks.sliding_window_view(np.concatenate([w, np.full(V, -1)]).astype(">i4"), V)[self.at]
        names = np.ascontiguousarray(blocks).view(np.dtype((np.void, 4 * V))).reshape(-1)
        levels = [np.unique(names, return_inverse=True)[1].reshape(-1)]  # ranks by 1, 2, 4, ... blocks
        m = len(self.at)
        while (top := int(levels[-1].max())) + 1 < m:
            ahead = np.arange(m) + (1 << len(levels) - 1)
            inside = (ahead < m) & (self.at[np.minimum(ahead, m - 1)] > self.at)
            after = np.where(inside, levels[-1][np.minimum(ahead, m - 1)] + 1, 0)
            levels.append(np.unique(levels[-1] * (top + 2) + after, return_inverse=True)[1].reshape(-1))
        self.rank = levels[-1]
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            common, a, b = common + same, a + same, b + same
        self.minima = [common]
        while 2 << len(self.minima) - 1 < m:
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _blocks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Blocks that the sampled suffixes a and b have in common."""
        ra, rb = self.rank[self.index[a]], self.rank[self.index[b]]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        k = np.frexp((high - low).astype(np.float64))[1] - 1  # the largest power of two inside the range
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            of = np.flatnonzero(k == level)
            table = self.minima[level]
            out[of] = np.minimum(table[low[of]], table[high[of] - (1 << level)])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """i <> j in every pair."""
        to_sample = (SHIFT[(j - i) % V] - i) % V
        out = matching(self.w, i, j, to_sample)
        on = np.flatnonzero(out == to_sample)
        if len(on):
            out[on] += V * self._blocks(i[on] + out[on], j[on] + out[on])
            out[on] += matching(self.w, i[on] + out[on], j[on] + out[on], np.full(len(on), V))
        return out


def _places(ends: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grid over texts that end at `ends` (each text and its separator, after a separator at 0)."""
    sizes = np.diff(ends) - 1
    n, longest = int(ends[-1]) + 1, int(sizes.max(initial=0)) // times
    q = 1
    while q <= longest:
        counts, last = 0, q
        while last <= longest and counts <= PLACES:
            step = max(1, min((PLACES - counts) * (times - 1) * last // n, longest + 1 - last))
            counts += step * (n // ((times - 1) * last) + 1)
            last += step
        periods = np.arange(q, last)
        many = (n - 1) // ((times - 1) * periods) + 1
        p = np.repeat(periods, many)
        k = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
        i = k * (times - 1) * p
        fits = i + p < n
        yield i[fits], p[fits]
        q = last


def runs_of(texts: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs of texts of word numbers (0 and up), by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    # separators count down from -2; one stands at either end
    parts = [np.array([-2])]
    for k, t in enumerate(texts):
        parts += [t, np.array([-3 - k])]
    w = np.concatenate(parts).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])  # places of the separators
    text = np.repeat(np.arange(len(texts) + 1), np.concatenate([[1], sizes + 1])) - 1
    found = [_worth(w, text, i, q, sizes, least, times) for i, q in _places(ends, times)]
    i, q = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in (0, 1))
    none = np.empty(0, np.int64)
    if not len(i):
        return none, none, none, none
    # what is left is measured in the texts that it lies in
    some = np.unique(text[i])
    keep = np.zeros(len(texts), bool)
    keep[some] = True
    mask = np.concatenate([[True], np.repeat(keep, sizes + 1)])
    moved = np.cumsum(mask) - 1
    v, iv = w[mask], moved[i]
    n = len(v)
    ahead, back = Lce(v), Lce(v[::-1])
    found = set()
    for at in range(0, len(iv), PLACES):
        x, p = iv[at : at + PLACES], q[at : at + PLACES]
        right, left = ahead(x, x + p), back(n - x, n - x - p)  # reversed, the word before x stands at n - x
        length = right + left + p
        good = length >= np.maximum(least, times * p)
        found |= set(zip((i[at : at + PLACES] - left)[good].tolist(), length[good].tolist(), p[good].tolist(), strict=True))
    # the same stretch under several periods: the smallest is the run's
    smallest: dict[tuple[int, int], int] = {}
    for s, length, p in found:
        smallest[s, length] = min(p, smallest.get((s, length), p))
    made = np.array(sorted((s, p, length) for (s, length), p in smallest.items()), np.int64).reshape(-1, 3)
    of = text[made[:, 0]] if len(made) else none
    return of, made[:, 0] - ends[of] - 1, made[:, 2], made[:, 1]


def _worth(w, text, i, q, sizes, least, times) -> tuple[np.ndarray, np.ndarray]:
    """The places whose stretch may be long enough: it is measured as far as PEEK words either way."""
    good = (w[i] == w[i + q]) & (text[i] == text[i + q])
    i, q = i[good], q[good]
    enough = np.maximum(least - q, (times - 1) * q)
    right = matching(w, i, i + q, np.full(len(i), PEEK))
    r = w[::-1]
    n = len(w)
    left = matching(r, n - i, n - i - q, np.full(len(i), PEEK))
    good = (right == PEEK) | (left == PEEK) | (right + left >= enough)
    return i[good], q[good]


RUNS = "array<struct<start:long,length:long,period:long>>"


def _batch(batch: pa.RecordBatch) -> dict:
    texts = [x.encode("utf-8", "surrogatepass").split() for x in batch["text"].to_pylist()]
    flat = pa.array([x for t in texts for x in t], pa.binary())
    numbers = flat.dictionary_encode().indices.to_numpy() if len(flat) else np.empty(0, np.int64)
    cuts = np.cumsum([len(t) for t in texts])[:-1]
    of, start, length, period = runs_of(np.split(numbers, cuts))
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    runs, collapsed = [], []
    for k, t in enumerate(texts):
        mine = slice(bounds[k], bounds[k + 1])
        spans = list(zip(start[mine].tolist(), length[mine].tolist(), period[mine].tolist(), strict=True))
        runs.append([{"start": s, "length": n, "period": p} for s, n, p in spans])
        if spans:
            gone = np.zeros(len(t) + 1, np.int64)
            for s, n, p in spans:
                gone[s + p] += 1
                gone[s + n] -= 1
            t = [t[x] for x in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
        collapsed.append(b" ".join(t).decode("utf-8", "surrogatepass"))
    return {"n_words": np.diff(np.concatenate([[0], cuts, [len(flat)]])), "runs": runs, "collapsed": collapsed}


def periodic_runs(docs: DataFrame) -> DataFrame:
    """All columns of docs, and n_words, runs (by start, then period) and collapsed: the words that repeat nothing, joined by a
    space. Columns of these names are replaced."""
    made = {"n_words", "runs", "collapsed"}
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    others = [c for c in docs.columns if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"), F.coalesce("text", F.lit("")).alias("text"))
    schema = StructType([rows.schema["__row"], *_parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string")])
    found = map_batches(rows, lambda batch: {"__row": batch["__row"]} | _batch(batch), schema)
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in others], "n_words", "runs", "collapsed")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """docs in which texts of ids with crc32 % 10 = 0 (of the decimal id; h) repeat themselves from word a on: with g = h div 10, a = g % n and
    p = 1 + (n - a) div (3 + g % 8), word i >= a becomes word a + (i - a) % p. A text without words, or without an id, stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    planted = docs.withColumn("__w", F.when(h % 10 == 0, words))
    g, n = F.floor(h / 10), F.size("__w")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    moved = F.transform("__w", lambda x, i: F.when(i < a, x).otherwise(F.get("__w", a + (i - a) % p)))
    return planted.withColumn("text", F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text"))).drop("__w")


def with_digests(found: DataFrame) -> DataFrame:
    """n_runs, the longest run (ties: smallest start, then period) and digests, from doc_id, runs and collapsed."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n")))
    listed = found.withColumn("__best", best)
    return listed.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("__best.start")).alias("start"),
        F.col("__best.length").alias("length"),
        (-F.col("__best.period")).alias("period"),
        F.floor(1000 * F.col("__best.length") / -F.col("__best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
