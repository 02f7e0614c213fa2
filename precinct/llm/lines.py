"""Line dedup by a deletion-neighbourhood join.

A line counts by its text without white space at its ends; empty lines are never touched. Two lines are near if at most
one character must be inserted, deleted or replaced; lines under `MIN_FUZZY` characters are near only if equal.
Of the occurrences of a line, in (doc_id, line number) order, the first stays; a line that is near an earlier one goes
with all its occurrences. Whether the earlier line itself stays doesn't matter, so the result depends on no order
of work.

Exact repeats meet by a 128-bit digest. For near lines, every line emits hashed keys of its variants within the bound, itself and all
its one-character deletions, and equal variants join: lines that lose a character at the same place, or of which one is
what the other becomes by a loss, are near. A minimum for each key and place takes the place of pairs, so no group is
expanded, and every near pair is verified on its text. Keys are polynomials modulo two primes at bases drawn for each run.

Lines of `SHORT` characters or more are filtered first, without loss: one edit leaves one half whole, so only lines that share a
half (of the same length or one apart) can be near. Up to `GROUP` lines with one half are compared pair by pair; more of them emit the
variants of the other half, which join as above. Lines of exactly `SHORT` characters do both.

Null and empty texts stay as they are. Rows that repeat doc_id and text are one document; other texts under the same
doc_id are documents of their own. Rows without doc_id stay as they are and remove nothing. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import hinted, materialize
from precinct.llm.common import drawn_seed, map_batches, mixed, told_apart, with_found

MIN_FUZZY = 10
SHORT = 32
#: So many lines with one half are compared pair by pair; more meet by their variants.
GROUP = 32
ID, HALF, CUT, WHOLE = 0, 1, 2, 3  # kinds of keys: identity, a half, a deletion at a place, the line itself
#: Two primes below 2^31: products of remainders fit in 64 bits.
PRIMES = np.array([[2147483647], [2147483629]], np.uint64)


class Powers:
    """Bases of a run's polynomial hashes, one for each prime, and their powers; the tables grow with the longest line."""

    def __init__(self, seed: int):
        p = PRIMES[:, 0].tolist()
        self.bases = [2 + (seed >> 32 * k & 0xFFFFFFFF) % (p[k] - 3) for k in (0, 1)]
        self.back = np.array([[pow(b, -1, q)] for b, q in zip(self.bases, p, strict=True)], np.uint64)
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(powers, inverse powers) from 0 to at least n, a row a prime."""
        if n >= self.n:
            self.n = max(2 * n, 1024)
            both = [[self._table(b, q) for b, q in zip(base, PRIMES[:, 0].tolist(), strict=True)] for base in (self.bases, self.back[:, 0].tolist())]
            self.up, self.down = (np.array(x, np.uint64) for x in both)
        return self.up, self.down

    def _table(self, base: int, q: int) -> list[int]:
        out = [1]
        for _ in range(self.n):
            out.append(out[-1] * base % q)
        return out


_POWERS: dict[int, Powers] = {}


def powers(seed: int) -> Powers:
    if seed not in _POWERS:
        _POWERS.clear()
        _POWERS[seed] = Powers(seed)
    return _POWERS[seed]


def line_id(line: str) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")))


class Sums:
    """Hashes of all stretches of many lines: running sums of a polynomial in the characters' numbers, a row a prime."""

    def __init__(self, p: Powers, lines: list[str]):
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.n) - self.n
        self.back = p.back
        up, self.down = p.upto(int(self.n.max(initial=0)))
        place = np.arange(len(code)) - np.repeat(self.start, self.n)
        self.sums = np.zeros((2, len(code) + 1), np.uint64)
        np.cumsum(code * up[:, place] % PRIMES, axis=1, out=self.sums[:, 1:])

    def _span(self, begin: np.ndarray, end: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return (self.sums[:, end] - self.sums[:, begin]) % PRIMES * self.down[:, offset] % PRIMES

    def halves(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, begins, ends), four to a line: keys of either half for the line's own length and for the length below, and where
        the rest of the line is."""
        n, s = self.n[which], self.start[which]
        keys, begins, ends = [], [], []
        for shorter in (n, n - 1):
            h = shorter // 2
            keys += [_scoped(self._span(s, s + h, 0 * h), 2 * shorter + 1), _scoped(self._span(s + n - h, s + n, n - h), 2 * shorter + 2)]
            begins += [h, 0 * h]
            ends += [n, n - h]
        return tuple(np.stack(x, axis=1) for x in (keys, begins, ends))

    def cuts(self, which: np.ndarray, begin: np.ndarray, end: np.ndarray, scope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, place) for stretches of lines: without each one of their characters, and (place -1) whole, last."""
        size = end - begin + 1
        of = np.repeat(np.arange(len(which)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        whole = place == size[of] - 1
        a, b = self.start[which] + begin, self.start[which] + end
        at = a[of] + place
        first = (self.sums[:, at] - self.sums[:, a[of]]) % PRIMES
        last = (self.sums[:, b[of]] - self.sums[:, np.minimum(at + 1, b[of])]) % PRIMES * self.back % PRIMES
        keys = (first + last) % PRIMES * self.down[:, begin[of]] % PRIMES
        return _scoped(keys, scope[of]), np.where(whole, -1, place).astype(np.int32)


def _scoped(keys: np.ndarray, scope: np.ndarray) -> np.ndarray:
    return mixed((keys[0] << np.uint64(31) | keys[1]) ^ mixed(scope.astype(np.uint64))).view(np.int64)


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


KEYED = "kind tinyint, key long, place int, h1 long, h2 long, doc_id long, tx long, line int"
_NAMES = [c.split()[0] for c in KEYED.split(", ")]


#: Keys that a task hands on together.
HANDED = 100_000


def _keyed(kind, key: np.ndarray, place, rows: np.ndarray, of: np.ndarray) -> dict:
    """Columns of KEYED; rows: h1, h2, doc_id, tx and line of each line, as rows of numbers."""
    full = lambda x, t: np.full(len(key), x, t) if np.isscalar(x) else x
    return {"kind": full(kind, np.int8), "key": key, "place": full(place, np.int32)} | dict(zip(_NAMES[3:], rows[:, of], strict=True))


def _cut_keys(sums: Sums, which: np.ndarray, begin: np.ndarray, end: np.ndarray, scope: np.ndarray, rows: np.ndarray, of: np.ndarray) -> Iterator[dict]:
    """Variants of stretches of lines, about HANDED at a time."""
    turn = np.cumsum(end - begin + 1) // HANDED
    for k in np.unique(turn):
        mine = turn == k
        keys, place = sums.cuts(which[mine], begin[mine], end[mine], scope[mine])
        size = (end - begin + 1)[mine]
        yield _keyed(np.where(place < 0, WHOLE, CUT).astype(np.int8), keys, place, rows, np.repeat(of[mine], size))


def _emit(docs: DataFrame, seed: int) -> DataFrame:
    """A row for every key of every line: its identity, and its half keys or its variants."""

    def one(batch: pa.RecordBatch) -> Iterator[dict]:
        seen: set[tuple[int, int]] = set()
        ids = list(zip(batch["doc_id"].to_pylist(), batch["tx"].to_pylist(), strict=True))
        in_order = all(a <= b for a, b in zip(ids, ids[1:], strict=False))  # then a line's later occurrences need no keys again
        found, fuzzy, lines = [], [], []
        for (d, tx), text in zip(ids, batch["text"].to_pylist(), strict=True):
            for k, raw in enumerate(text.split("\n")):
                if not (line := raw.strip()):
                    continue
                a, b = line_id(line)
                if len(line) >= MIN_FUZZY and ((a, b) not in seen or not in_order):
                    seen.add((a, b))
                    fuzzy.append(len(found))
                    lines.append(line)
                found.append((a, b, d, tx, k))
        rows, of = np.array(found, np.int64).reshape(-1, 5).T, np.array(fuzzy, np.int64)
        for at in range(0, rows.shape[1], HANDED):
            some = np.arange(at, min(at + HANDED, rows.shape[1]))
            yield _keyed(ID, np.zeros(len(some), np.int64), -1, rows, some)
        sums = Sums(powers(seed), lines)
        long, short = np.flatnonzero(sums.n >= SHORT), np.flatnonzero(sums.n <= SHORT)
        if len(long):
            yield _keyed(HALF, sums.halves(long)[0].reshape(-1), -1, rows, np.repeat(of[long], 4))
        if len(short):
            yield from _cut_keys(sums, short, 0 * sums.n[short], sums.n[short], 0 * short, rows, of[short])

    return map_batches(docs, one, KEYED, 1_000_000)


def fetch_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of wanted lines (h1, h2, doc_id, tx, line), as h1, h2, text, doc_id, tx, line."""
    by_doc = materialize(wanted.groupBy("doc_id", "tx").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("want")), "wanted")
    found = docs.join(hinted(by_doc), ["doc_id", "tx"])

    def one(batch: pa.RecordBatch) -> dict:
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["want"]).to_numpy(zero_copy_only=False))
        line, h1, h2 = batch["want"].flatten().flatten()
        numbers, bounds = line.to_numpy(), np.searchsorted(of, np.arange(batch.num_rows + 1))
        texts = []
        for k in range(batch.num_rows):  # one text at a time, and no object a number
            lines = batch["text"][k].as_py().split("\n")
            texts += [lines[x].strip() for x in numbers[bounds[k] : bounds[k + 1]].tolist()]
        at = pa.array(of)
        return {"h1": h1, "h2": h2, "text": texts, "doc_id": batch["doc_id"].take(at), "tx": batch["tx"].take(at), "line": line}

    return map_batches(found.select("doc_id", "tx", "text", "want"), one, "h1 long, h2 long, text string, doc_id long, tx long, line int")


_PLACE = ["doc_id", "tx", "line"]


def _near_by_variants(keys: DataFrame) -> DataFrame:
    """(h1, h2, first, o1, o2, other_first): lines with an earlier line at one key. keys: kind, key, place, h1, h2, first."""
    earliest = F.min(F.struct("first", "h1", "h2"))
    cut, whole = keys.filter(F.col("kind") == CUT), keys.filter(F.col("kind") == WHOLE)
    same = cut.groupBy("key", "place").agg(earliest.alias("e"), F.count("*").alias("n")).filter("n > 1").select("key", "place", "e")
    of = lambda df: df.groupBy("key").agg(earliest.alias("e"))
    cols = ["h1", "h2", "first", F.col("e.h1").alias("o1"), F.col("e.h2").alias("o2"), F.col("e.first").alias("other_first")]
    found = cut.join(same, ["key", "place"]).select(cols).union(cut.join(of(whole), "key").select(cols)).union(whole.join(of(cut), "key").select(cols))
    return found.filter("other_first < first and (o1 <> h1 or o2 <> h2)").distinct()


def near_earlier(docs: DataFrame, emitted: DataFrame, seed: int) -> DataFrame:
    """h1, h2 of the lines that are near an earlier line."""
    first = F.min(F.struct(*_PLACE)).alias("first")
    short = emitted.filter(F.col("kind").isin(CUT, WHOLE)).groupBy("kind", "key", "place", "h1", "h2").agg(first)
    half = emitted.filter(F.col("kind") == HALF)
    both = lambda f, n: f(F.struct("h1", "h2")).alias(n)
    shared = materialize(half.groupBy("key").agg(both(F.min, "low"), both(F.max, "high")).filter("low <> high").select("key"), "shared-halves")
    rows = materialize(half.join(hinted(shared), "key").groupBy("key", "h1", "h2").agg(first), "half-rows")
    sized = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")), "key")
    few, many = sized.filter(F.col("n") <= GROUP), sized.filter(F.col("n") > GROUP)
    other = few.select("key", F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("first").alias("other_first"))
    pairs = few.join(other, "key").filter("other_first < first and (o1 <> h1 or o2 <> h2)").select("h1", "h2", "first", "o1", "o2", "other_first").distinct()
    lines = materialize(many.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.collect_set("key").alias("keys")).select("h1", "h2", "first.*", "keys"), "half-lines")  # at most four keys a line
    texts = fetch_lines(docs, lines.drop("keys")).join(lines.select("h1", "h2", "keys"), ["h1", "h2"])
    long = _variants(texts, seed).withColumn("first", F.struct(*_PLACE)).select("kind", "key", "place", "h1", "h2", "first").distinct()
    near = _near_by_variants(materialize(short, "short-variants")).union(pairs).union(_near_by_variants(materialize(long, "long-variants")))
    return _verified(docs, materialize(near.distinct(), "near-pairs"))


def _variants(texts: DataFrame, seed: int) -> DataFrame:
    """For lines that share a half with many others, the variants of the rest."""

    def one(batch: pa.RecordBatch) -> Iterator[dict]:
        rows = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("h1", "h2", "doc_id", "tx", "line")])
        sums = Sums(powers(seed), batch["text"].to_pylist())
        keys, begin, end = sums.halves(np.arange(batch.num_rows))
        wanted = [set(x) for x in batch["keys"].to_pylist()]
        of, half = np.nonzero(np.array([[k in w for k in mine] for mine, w in zip(keys.tolist(), wanted, strict=True)], bool).reshape(-1, 4))
        yield from _cut_keys(sums, of, begin[of, half], end[of, half], keys[of, half], rows, of)

    return map_batches(texts.select("h1", "h2", "doc_id", "tx", "line", "text", "keys"), one, KEYED, 500_000)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    lines = pairs.select("h1", "h2", "first.*").union(pairs.select("o1", "o2", "other_first.*")).distinct()
    texts = materialize(fetch_lines(docs, lines).select("h1", "h2", "text").dropDuplicates(["h1", "h2"]), "line-texts")
    both = pairs.join(texts, ["h1", "h2"]).join(texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("text").alias("other_text")), ["o1", "o2"])

    def one(batch: pa.RecordBatch) -> dict:
        good = pa.array([within_one(a, b) for a, b in zip(batch["text"].to_pylist(), batch["other_text"].to_pylist(), strict=True)], pa.bool_())
        return {"h1": batch["h1"].filter(good), "h2": batch["h2"].filter(good)}

    return map_batches(both.select("h1", "h2", "text", "other_text"), one, "h1 long, h2 long").distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, tx and the sorted numbers of its lines that go. docs: told_apart."""
    seed = drawn_seed()
    emitted = materialize(_emit(docs, seed), "line-keys")
    lines = emitted.filter(F.col("kind") == ID)
    near = materialize(near_earlier(docs, emitted, seed), "near-lines")
    first = lines.groupBy("h1", "h2").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count("*").alias("n"))
    verdict = materialize(first.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").filter("n > 1 or near").drop("n"), "line-verdicts")
    goes = lines.join(hinted(verdict), ["h1", "h2"]).filter(F.col("near").isNotNull() | (F.struct(*_PLACE) > F.col("first")))
    return goes.groupBy("doc_id", "tx").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, removed: str = "removed") -> DataFrame:
    """All columns of docs with the text that stays, and the column `removed`, the numbers of the lines that went (or null). A
    column of that name is replaced; give another name to keep it."""
    keyed = told_apart(docs)
    gone = materialize(repeated_lines(keyed), "removed-lines")
    joined = with_found(docs, keyed, gone, "__found")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, k: ~F.array_contains("__found.removed", k)), "\n")
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(kept).alias("text")
    return joined.select(*[text if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != removed], F.col("__found.removed").alias(removed))
