"""Language-model scores by Brown class-based bigrams.

P(text) = product over its tokens, one end included, of P(class | class before) P(token | class). Every training word
seen at least `MIN_COUNT` times gets a class by exchange clustering. The `SEEDS` most frequent words are clustered first,
one after the other: each moves to the class that raises the likelihood of the class bigrams most, until a sweep
moves few. Then all other words move in sweeps, each to its best class while the classes of its neighbours are held, until a
sweep gains little; Spark sums each word's counts by the class of its neighbours, in packed blocks dealt out by the
word. Rarer and unseen words share three classes by their shape (letters, letters and a sign, all else). Transitions
are smoothed towards the class's own frequency; in the shape classes a word has probability
(c + 1) / (N_s + V_s + 1).

Texts become blocks of word numbers once. A table of the most frequent words (at most `LEXICON`, all seen equally often or
more) goes to every task; what is known of all other words, however many, comes by a join on the word's key, a 64-bit hash with
its shape. What the driver holds is bounded: the lexicon and the bigram tables of the seeds and of the classes.

Null texts count as empty (one token, the end). Rows without doc_id are training rows; repeated rows are scored and
counted each. Without training documents every count is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import materialize
from precinct.llm.common import HashedWords, dealt_schema, docs_text, packed, remainder, slices, undealt, unpacked

LEXICON = 4_000_000
SEEDS = 1000
MIN_COUNT = 3
CLASSES = 64
SWEEPS = 6
#: Sweeps over all words, after those over the seeds.
ROUNDS = 2
SMOOTH = 20.0
#: Words that a task holds before it hands counts on, and counts of a bucket of words.
HELD, BUCKET = 2_000_000, 400_000

#: Shapes of words outside the clustering: letters, letters with a sign at the end, all else.
SHAPES = 3
_SIGN = np.array([not (c >= 128 or chr(c).isalpha() or c == 32 or 9 <= c <= 13) for c in range(256)])
_STOP = np.array([chr(c) in ".,;:!?" for c in range(256)])


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(key of every word, words of each text): a hash whose low two bits are 1 + the word's shape. 0 is the end."""
    w = HashedWords(texts)
    if not len(w.starts):
        return np.empty(0, np.int64), w.counts
    signs = np.add.reduceat(_SIGN[w.raw].astype(np.int32), w.starts)
    shape = np.where(signs == 0, 0, np.where((signs == 1) & _STOP[w.raw[w.stops() - 1]], 1, 2))
    return ((w.hashes & ~np.uint64(3)) | (shape + 1).astype(np.uint64)).view(np.int64), w.counts


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, how often each) of a sorted array."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) over all rows; every task hands on partial counts of bounded size."""
    arrow = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            key, n = _runs(np.sort(np.concatenate(held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], schema=arrow)

        for b in batches:
            for piece in slices(b):
                key, _ = word_keys(piece["text"])
                held.append(key)
                size += len(key)
                if size >= HELD:
                    size = 0
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


#: Steps of the log scale from one count to its double, and a count that no word has.
STEPS, NONE = 64, 1 << 62

#: Ids in blocks: those below it are the shapes of words outside the lexicon, then come the lexicon's words by key.
FIRST = SHAPES


def index(docs: DataFrame, keys: np.ndarray) -> DataFrame:
    """A row for every block of texts: block, doc_ids, held_out, sizes, ids (packed), and for the words outside the lexicon
    rare (their keys) and rare_at (packed places). keys: the lexicon's, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    arrow = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary()), ("rare", pa.list_(pa.int64())), ("rare_at", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, block = shared.value, TaskContext.get().partitionId() << 32
        for b in batches:
            for piece in slices(b):
                key, counts = word_keys(piece["text"])
                at = np.minimum(np.searchsorted(lexicon, key), max(len(lexicon) - 1, 0))
                there = lexicon[at] == key if len(lexicon) else np.zeros(len(key), bool)
                rare = np.flatnonzero(~there)
                ids = np.where(there, at + FIRST, (key & 3) - 1)
                row = [[block], [piece["doc_id"].to_pylist()], [piece["held_out"].to_pylist()], [counts.tolist()], [packed(ids, "<u4")], pa.array([key[rare].tolist()], pa.list_(pa.int64())), [packed(rare, "<u4")]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(row, arrow, strict=True)], schema=arrow)
                block += 1

    return docs.mapInArrow(run, "block long, doc_ids array<long>, held_out array<boolean>, sizes array<int>, ids binary, rare array<long>, rare_at binary")


class Block:
    """A row of `index` as arrays. classes(of): class of each word, of those outside the lexicon by the row's `patch`."""

    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held_out"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ids = unpacked(row["ids"], "<u4").astype(np.int64)
        self.rare, self.rare_at = np.array(row["rare"], np.int64), unpacked(row["rare_at"], "<u4").astype(np.int64)
        patch = row.get("patch") or []
        self.own = self.rare_at[np.array([p["at"] for p in patch], np.int64)]  # words outside the lexicon that can move
        self.own_key = self.rare[np.array([p["at"] for p in patch], np.int64)]
        self.own_class, self.own_n = (np.array([p[f] for p in patch], np.int64) for f in ("cls", "n"))

    def classes(self, of: np.ndarray) -> np.ndarray:
        out = of[self.ids].astype(np.int64)
        out[self.own] = self.own_class
        return out

    def lined_up(self, values: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of the kept documents' words with 0, the end, around every document; place of each word in it)."""
        sizes = self.sizes[kept]
        place = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(sizes)), sizes) + 1
        out = np.zeros(len(place) + len(sizes) + 1, np.int64)
        out[place] = values[np.repeat(kept, self.sizes)]
        return out, place


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for k in range(b.num_rows):
            yield Block(b.slice(k, 1).to_pylist()[0])


def _summed_pairs(blocks: DataFrame, of: np.ndarray, size: int) -> np.ndarray:
    """Training bigrams by the numbers below `size` that `of` (or the patch) gives the words; 0 is the end."""
    shared = blocks.sparkSession.sparkContext.broadcast(of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _each_block(batches):
            x, _ = block.lined_up(block.classes(shared.value), ~block.held)
            n = np.bincount(x[:-1] * size + x[1:], minlength=size * size)
            total = n if total is None else total + n
        if total is not None:
            rows = total.reshape(size, size)
            full = np.flatnonzero(rows.any(axis=1))
            yield pa.RecordBatch.from_pydict({"x": pa.array(full, pa.int32()), "n": pa.array([packed(rows[k], "<i8") for k in full], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for x, n in zip(b["x"].to_pylist(), b["n"].to_pylist(), strict=True):
                total[x] = total.get(x, 0) + unpacked(n, "<i8")
        if total:
            yield pa.RecordBatch.from_pydict({"x": pa.array(list(total), pa.int32()), "n": pa.array([packed(n, "<i8") for n in total.values()], pa.binary())})

    out = np.zeros((size, size))
    for r in blocks.mapInArrow(count, "x int, n binary").repartition("x").mapInArrow(add, "x int, n binary").collect():
        out[r["x"]] = unpacked(r["n"], "<i8")
    return out


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(n: np.ndarray, clustered: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol: 0 the end, 1..classes the words, then one for each shape."""
    size = len(n)
    classes = max(1, min(classes, clustered))
    of = np.zeros(size, np.int64)
    of[1 : clustered + 1] = 1 + np.arange(clustered) % classes
    of[clustered + 1 :] = classes + 1 + np.arange(size - clustered - 1)
    total = int(of.max()) + 1
    add = lambda v: np.bincount(of, weights=v, minlength=total)
    g = np.array([np.bincount(of, weights=row, minlength=total) for row in np.array([np.bincount(of, weights=col, minlength=total) for col in n.T]).T])
    for _ in range(sweeps):
        moved = 0
        for w in range(1, clustered + 1):
            was, own = of[w], n[w, w]
            out, into = add(n[w]), add(n[:, w])
            new = best_class(g, was, out, into, own, classes)
            moved += new != was
            of[w] = new
            put(g, new, out, into, own, 1)
        if moved <= clustered // 200:
            break
    return of


def put(g: np.ndarray, k: int, out: np.ndarray, into: np.ndarray, own: float, sign: int) -> None:
    """Add a word to class k, or take it out: its counts by the class after and before it, and with itself."""
    g[k] += sign * out
    g[:, k] += sign * into
    g[k, k] += sign * own


def best_class(g: np.ndarray, was: int, out: np.ndarray, into: np.ndarray, own: float, classes: int) -> int:
    """The class of 1..classes in which a word makes the likelihood greatest. Takes the word out of g, and what it has
    with itself out of `out` and `into`."""
    out[was] -= own
    into[was] -= own
    put(g, was, out, into, own, -1)
    words = slice(1, classes + 1)
    o, i, a, b = out[words], into[words], np.flatnonzero(out), np.flatnonzero(into)
    rows, cols = g[words], g[:, words].T
    # The gain of class k: its row, its column, its own cell (counted once), less the marginals.
    gain = (_phi(rows[:, a] + out[a]) - _phi(rows[:, a])).sum(1) + (_phi(cols[:, b] + into[b]) - _phi(cols[:, b])).sum(1)
    d = np.diagonal(rows[:, words])
    gain += _phi(d + o + i + own) - _phi(d + o) - _phi(d + i) + _phi(d)
    r, c = rows.sum(1) + i, cols.sum(1) + o  # what comes from and goes to the class's own words counts wherever w goes
    gain -= _phi(r + out.sum() + own) - _phi(r) + _phi(c + into.sum() + own) - _phi(c)
    return int(was) if 1 <= was <= classes and gain[was - 1] >= gain.max() - 1e-9 else int(np.argmax(gain)) + 1


def likelihood(g: np.ndarray) -> float:
    return float(_phi(g).sum() - _phi(g.sum(0)).sum() - _phi(g.sum(1)).sum())


# -- Sweeps over all words -----------------------------------------------------------------------------------------------

#: Of a block's words: key, class now and whether it is in the lexicon, number of contexts. Of the contexts: side and class, count.
WORDS_, SEEN = {"key": "<i8", "was": "u1", "lex": "u1", "k": "u1"}, {"ctx": "u1", "n": "<u4"}


def _contexts(blocks: DataFrame, lexicon: Lexicon, buckets: int) -> DataFrame:
    """Each word's counts by the class before and after it, in every block, dealt out by the word."""
    shared, total = blocks.sparkSession.sparkContext.broadcast(lexicon), lexicon.total
    schema = pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in (*WORDS_, *SEEN)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        for block in _each_block(batches):
            train = ~block.held
            x, place = block.lined_up(block.classes(lex.of), train)
            # Words by number: the lexicon's, then those outside it that can move; all others and the seeds stay.
            word = np.where(block.ids >= FIRST, block.ids, -1)
            more, back = np.unique(block.own_key, return_inverse=True)
            word[block.own] = len(lex.of) + back
            word[np.isin(block.ids, lex.seeds)] = -1
            word = word[np.repeat(train, block.sizes)]
            moves = word >= 0
            w, p = word[moves], place[moves]
            seen, n = _runs(np.sort(np.concatenate([(w * 2) * total + x[p - 1], (w * 2 + 1) * total + x[p + 1]])))
            if not len(seen):
                continue
            w, k = _runs(seen // (2 * total))
            out = w >= len(lex.of)
            key = np.where(out, more[np.where(out, w - len(lex.of), 0)] if len(more) else 0, lex.keys[np.minimum(w, len(lex.of) - 1) - FIRST])
            was = np.zeros(len(w), np.int64)
            was[~out] = lex.of[w[~out]].astype(np.int64)
            if out.any():
                now = np.zeros(len(more), np.int64)
                now[back] = block.own_class
                was[out] = now[w[out] - len(lex.of)]
            bucket = ((key.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            start = np.cumsum(k) - k
            k = k[order]
            entry = np.repeat(start[order] - (np.cumsum(k) - k), k) + np.arange(len(seen))
            values = {"key": key[order], "was": was[order], "lex": ~out[order], "k": k, "ctx": (seen % (2 * total))[entry], "n": n[entry]}
            name, words = _runs(bucket[order])
            w_end, e_end = np.cumsum(words), np.cumsum(k)[np.cumsum(words) - 1]
            cut = lambda f, kind, ends: [packed(values[f][a:b], kind) for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True)]  # noqa: E731, B023
            made = [cut(f, kind, w_end) for f, kind in WORDS_.items()] + [cut(f, kind, e_end) for f, kind in SEEN.items()]
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), *[pa.array(m, pa.binary()) for m in made]], schema=schema)

    return blocks.mapInArrow(run, dealt_schema(WORDS_ | SEEN))


def best_classes(g: np.ndarray, classes: int, was: np.ndarray, k: np.ndarray, ctx: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each word's best class by its contexts (k[w] of them, in order), all other words being where they are: the exchange's
    gain, with what a word has with its own class's other words counted by that class."""
    total, every = len(g), slice(1, classes + 1)
    begin = np.cumsum(k) - k
    word = np.repeat(np.arange(len(k)), k)
    rows = np.concatenate([g[:, every], g[every].T])  # [side and class of the neighbour, class of the word]
    gain = np.empty((len(k), classes))
    stay = np.zeros(len(k))
    inside = (was >= 1) & (was <= classes)
    mine = rows[ctx, np.where(inside, was - 1, 0)[word]]
    stay += np.add.reduceat(_phi(mine) - _phi(np.maximum(mine - n, 0)), begin)
    least = np.minimum(n, 16)
    small = np.arange(17)[:, None, None]
    table = _phi(rows[None] + small) - _phi(rows)[None]
    step = max(1, 40_000 * len(k) // max(len(ctx), 1))
    for a in range(0, len(k), step):
        b = min(a + step, len(k))
        lo, hi = begin[a], begin[b - 1] + k[b - 1]
        c, m = ctx[lo:hi], n[lo:hi]
        part = table[least[lo:hi], c]
        big = np.flatnonzero(m > 16)
        part[big] = _phi(rows[c[big]] + m[big, None]) - _phi(rows[c[big]])
        gain[a:b] = np.add.reduceat(part, begin[a:b] - lo)
    for side, marginal in ((0, g[:, every].sum(0)), (1, g[every].sum(1))):
        size = np.add.reduceat(np.where((ctx >= total) == bool(side), n, 0), begin).astype(float)
        gain -= _phi(marginal + size[:, None]) - _phi(marginal)
        own = marginal[np.where(inside, was - 1, 0)]
        stay -= _phi(own) - _phi(np.maximum(own - size, 0))
    gain[inside, was[inside] - 1] = stay[inside]
    new = gain.argmax(1) + 1
    kept = inside & (stay >= gain.max(1) - 1e-9)
    return np.where(kept, was, new)


def _moved(contexts: DataFrame, g: np.ndarray, classes: int, tasks: int) -> DataFrame:
    """key, cls, lex: every word in its best class."""
    fields = WORDS_ | SEEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in undealt(batches, fields):
            key, head, number = np.unique(x["key"], return_index=True, return_inverse=True)
            word = number[np.repeat(np.arange(len(number)), x["k"].astype(np.int64))]
            code = word * 256 + x["ctx"]
            order = np.argsort(code, kind="stable")
            seen, many = _runs(code[order])
            n = np.add.reduceat(x["n"][order].astype(np.int64), np.cumsum(many) - many)
            _, k = _runs(seen // 256)
            new = best_classes(g, classes, x["was"][head].astype(np.int64), k, seen % 256, n)
            yield pa.RecordBatch.from_pydict({"key": pa.array(key, pa.int64()), "cls": pa.array(new, pa.int32()), "lex": pa.array(x["lex"][head] > 0, pa.bool_())})

    return contexts.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "key long, cls int, lex boolean")


class Lexicon:
    """keys (sorted) and counts of the lexicon's words, and `of`: the class of each id of a block."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, classes: int):
        self.keys, self.counts, self.classes, self.total = keys, counts, classes, classes + 1 + SHAPES
        shape = np.concatenate([np.arange(SHAPES), (keys & 3) - 1])
        self.of, self.seeds = (classes + 1 + shape).astype(np.uint8), np.empty(0, np.int64)


class Fitted:
    """The counts, the classes and what the driver needs of them. outside: key, n, cls of the words beyond the lexicon that
    have a class; blocks: the index of all texts."""

    def __init__(self, docs: DataFrame):
        """docs: doc_id, text, held_out."""
        training = docs.filter("not held_out")
        self.vocabulary = counted = materialize(word_counts(training), "vocabulary")
        self.ends = training.count()
        sizes = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        self.tokens, self.distinct = sizes["n"] + self.ends, sizes["v"] + (self.ends > 0)
        # The least count from which on all words fit in the lexicon, at steps of a log scale: a row a step meets here.
        step = F.floor(F.log2(F.col("n")) * STEPS)
        often = sorted(((r["c"], r["k"]) for r in counted.filter(F.col("n") >= MIN_COUNT).groupBy(step.alias("s")).agg(F.min("n").alias("c"), F.count("*").alias("k")).collect()), reverse=True)
        self.least, held = NONE, 0
        for c, k in often:
            if held + k > LEXICON:
                break
            self.least, held = c, held + k
        top = counted.filter(F.col("n") >= self.least).toArrow()
        keys, counts = top["key"].to_numpy(), top["n"].to_numpy()
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]  # a count takes 8 bytes, a class one
        self.blocks = materialize(index(docs, keys), "blocks")
        by_count = np.lexsort((keys, -counts))[:SEEDS]
        self.lexicon = lex = Lexicon(keys, counts, max(1, min(CLASSES, len(by_count))))
        lex.seeds = by_count + FIRST
        # Bigrams of the seeds; all other words by their shape.
        symbol = lex.of.astype(np.int32) - lex.classes + len(by_count)
        symbol[lex.seeds] = 1 + np.arange(len(by_count))
        self.open = any(c < self.least for c, _ in often)
        outside = counted.filter((F.col("n") >= MIN_COUNT) & (F.col("n") < self.least))
        self.outside = outside.select("key", "n", (F.col("key").bitwiseAND(F.lit(3).cast("long")) + lex.classes).cast("int").alias("cls"))
        n = _summed_pairs(self.blocks, symbol, len(by_count) + 1 + SHAPES)
        lex.of[lex.seeds] = exchange(n, len(by_count))[1 : len(by_count) + 1]
        self._sweeps(outside)
        rare = counted.filter(F.col("n") < MIN_COUNT).groupBy(F.col("key").bitwiseAND(F.lit(3).cast("long")).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        self.shapes = {r["s"] - 1: (r["n"], r["v"]) for r in rare.collect()}

    def _patched(self) -> DataFrame:
        """blocks with `patch`: place in rare, count and class of each occurrence of a word outside the lexicon that has a class."""
        if not self.open:
            return self.blocks
        found = self.blocks.select("block", F.posexplode("rare").alias("at", "key")).join(self.outside, "key").groupBy("block").agg(F.collect_list(F.struct("at", "cls", "n")).alias("patch"))
        return materialize(self.blocks.join(found, "block", "left"), "patched-blocks")

    def _sweeps(self, outside: DataFrame) -> None:
        lex = self.lexicon
        spark = self.blocks.sparkSession
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, 2 * self.tokens // BUCKET)
        blocks = self._patched()
        self.g = _summed_pairs(self.blocks, lex.of, lex.total)  # words outside the lexicon start in the class of their shape
        for _ in range(ROUNDS if self.ends else 0):
            new = materialize(_moved(_contexts(blocks, lex, buckets), self.g, lex.classes, max(tasks, buckets // 4)), "word-classes")
            was = (lex.of.copy(), self.outside, self.g, blocks)
            mine = new.filter("lex").select("key", F.col("cls").cast("tinyint").alias("cls")).toArrow()
            lex.of[np.searchsorted(lex.keys, mine["key"].to_numpy()) + FIRST] = mine["cls"].to_numpy()
            if self.open:
                self.outside = materialize(outside.select("key", "n").join(new.filter("not lex").select("key", "cls"), "key"), "outside-classes")
            blocks = self._patched()
            self.g = _summed_pairs(blocks, lex.of, lex.total)
            gain = likelihood(self.g) - likelihood(was[2])
            if gain < 0:
                lex.of, self.outside, self.g, blocks = was
            if gain <= 1e-3 * abs(likelihood(self.g)):
                break
        self.patched = blocks


class Model:
    """What a task needs: numbers for the ids of blocks, class transitions, and costs of the shapes."""

    def __init__(self, fit: Fitted):
        lex, g, classes = fit.lexicon, fit.g, fit.lexicon.classes
        tokens = g.sum(0)
        own = (tokens + 1) / (tokens.sum() + lex.total)
        self.step = np.log10((g + SMOOTH * own) / (g.sum(1, keepdims=True) + SMOOTH))
        self.shape_cost = np.zeros(lex.total)
        for s in range(SHAPES):
            n, v = fit.shapes.get(s, (0, 0))
            self.shape_cost[classes + 1 + s] = np.log10(n + v + 1)
        self.log_tokens = np.log10(np.maximum(tokens, 1))
        self.of = lex.of
        self.counts = np.concatenate([np.zeros(SHAPES, np.int64), lex.counts])


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"


def _scored(blocks: DataFrame, model: Model, end_more: float) -> DataFrame:
    """A row a document: `SCORED`, without what its words outside the lexicon add; rare has their keys."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        uid = TaskContext.get().partitionId() << 40
        for block in _each_block(batches):
            size, ids = block.sizes, block.ids
            docs = len(size)
            ends = np.cumsum(size)
            starts = ends - size
            run_of = lambda v: np.concatenate([[0.0], np.cumsum(v)])
            add = lambda v: run_of(v)[ends] - run_of(v)[starts]  # noqa: E731, B023
            classes = block.classes(m.of)
            count = m.counts[ids]
            emission = np.where(ids >= FIRST, np.log10(np.maximum(count, 1)) - m.log_tokens[classes], -m.shape_cost[classes])
            emission[block.own] = np.log10(np.maximum(block.own_n, 1)) - m.log_tokens[block.own_class]
            x, _ = block.lined_up(classes, np.ones(docs, bool))
            step = run_of(m.step[x[:-1], x[1:]])
            moves = step[ends + np.arange(docs) + 1] - step[starts + np.arange(docs)]
            known = add((ids >= FIRST).astype(np.int64)).astype(np.int64) + (end_more > 0)
            cut = np.searchsorted(block.rare_at, np.append(starts, len(ids)))
            rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(block.rare, pa.int64()))
            columns = [uid + np.arange(docs), pa.array(block.doc_ids, pa.int64()), block.held, size + 1, known, add(np.log10(count + 1)) + end_more, moves + add(emission), rare]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)
            uid += docs

    return blocks.mapInArrow(run, SCORED)


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row of docs."""
    docs = docs_text(docs).withColumn("held_out", F.col("doc_id").isNotNull() & (remainder(7) == 2))
    return scored_by(Fitted(docs))


def scored_by(fit: Fitted) -> DataFrame:
    made = materialize(_scored(fit.patched, Model(fit), float(np.log10(fit.ends + 1))), "scored")
    low = fit.vocabulary.filter(F.col("n") < fit.least)
    rare = made.select("uid", F.explode("rare").alias("key")).join(low, "key")
    logs = F.log10(F.col("n") + 1)
    # Words outside the lexicon with a class of their own are in the score already.
    sums = rare.groupBy("uid").agg(F.sum(logs).alias("more"), F.sum(F.when(F.col("n") < MIN_COUNT, logs).otherwise(0.0)).alias("more_score"), F.count("*").alias("seen"))
    out = made.drop("rare").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    base = F.col("base") + zero("more") - F.col("n_tokens") * float(np.log10(fit.tokens + fit.distinct + 1))
    score = F.col("score") + zero("more_score")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(fit.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
