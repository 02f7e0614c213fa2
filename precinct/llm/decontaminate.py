"""Benchmark decontamination with suffix arrays over training shards.

Every Arrow batch of documents is a shard. Its words become integers (words that no benchmark item has
become unmatched separators), a suffix array is built over the stretches that could hold a whole window,
and every suffix of every benchmark item is found in it by binary search. That gives, for each test suffix,
its longest verbatim match with its place, and every place where a whole window of the item occurs.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window.
Null and empty texts have no words and match nothing; repeated items each count; several equal item_ids
count once, items without an id as one item whose id is left out of the hash. Items are taken in blocks of at most `block_words` words, so what is broadcast is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.ranks import global_cumulate
from precinct.blocks.shared import hinted, materialize
from precinct.llm.common import docs_text, letter_words, map_batches

WINDOW = 10
#: Benchmark words held by a task at a time; more items are taken in further passes.
BLOCK_WORDS = 2_000_000


class TestSuffixes:
    """The windows of a block of benchmark items, as big-endian word ids, ready for binary search."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.window, self.ids, self.items, texts = window, {}, [], []
        for item, text in items:
            if words := letter_words(text or ""):
                texts.append([self.ids.setdefault(w, len(self.ids) + 1) for w in words])
                self.items.append(item)
        self.shortest = min((min(len(t), window) for t in texts), default=1)
        suffixes: dict[bytes, tuple[int, list]] = {}
        for k, t in enumerate(texts):
            n = min(len(t), window)
            for at in range(len(t) - n + 1):
                key = np.array(t[at : at + n], ">u4").tobytes()
                suffixes.setdefault(key, (n, []))[1].append((k, at))
        self.keys = sorted(suffixes)
        self.sizes = np.array([suffixes[k][0] for k in self.keys], np.int64)
        self.owners = [suffixes[k][1] for k in self.keys]  # (item, its first word in the item)


class ShardSuffixes:
    """A suffix array over the words of one shard that can take part in a match."""

    def __init__(self, docs: list[list[bytes]], test: TestSuffixes):
        get = test.ids.get
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.fromiter((get(w, 0) for d in docs for w in d), np.uint32, count=int(sizes.sum()))
        ends = np.cumsum(sizes)
        self.sizes = sizes
        # Stretches of known words within a document that are as long as the shortest window.
        known = flat > 0
        new_doc = np.zeros(len(flat) + 1, bool)
        new_doc[np.concatenate([[0], ends])] = True
        begin = np.flatnonzero(known & (new_doc[:-1] | np.concatenate([[True], ~known[:-1]])[: len(flat)]))
        breaks = np.flatnonzero(new_doc | np.concatenate([~known, [True]]))
        stop = breaks[np.searchsorted(breaks, begin, side="right")] if len(begin) else begin
        keep = stop - begin >= test.shortest
        begin, stop = begin[keep], stop[keep]
        length = stop - begin
        total = int(length.sum())
        inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        self.place = np.repeat(begin, length) + inner
        left = np.repeat(length, length) - inner
        self.doc = np.searchsorted(ends, self.place, side="right")
        self.at = self.place - (ends - sizes)[self.doc]
        width = test.window
        wide = np.zeros((total, width), ">u4")
        for k in range(width):
            ok = left > k
            wide[ok, k] = flat[self.place[ok] + k]
        keys = wide.reshape(-1).view(f"S{4 * width}") if total else np.empty(0, f"S{4 * width}")
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]

    def matches(self, test: TestSuffixes) -> Iterator[tuple[int, np.ndarray]]:
        """(suffix number, places of the suffix array) for each test suffix with a whole window here."""
        if not len(self.sorted) or not test.keys:
            return
        width = self.sorted.dtype.itemsize
        low = np.searchsorted(self.sorted, np.array(test.keys, f"S{width}"), side="left")
        high = np.searchsorted(self.sorted, np.array([k.ljust(width, b"\xff") for k in test.keys], f"S{width}"), side="right")
        for k in np.flatnonzero(high > low):
            yield int(k), self.order[low[k] : high[k]]


def _blocks(benchmark: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(block, item_id, text) in the shared folder, of about `most` words a block, and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = items.withColumns({"words": (F.length("text") / 2 + 1).cast("long"), "key": F.xxhash64("item_id", "text")})
    # Equal rows may change places; blocks then hold the same items.
    sized = global_cumulate(items, [F.asc("key"), F.asc_nulls_first("item_id"), F.asc("text")], {"upto": "words"})
    blocks = materialize(sized.select(F.floor((F.col("upto") - 1) / most).cast("long").alias("block"), "item_id", "text"), "benchmark-blocks")
    return blocks, (blocks.agg(F.max("block")).first()[0] or 0) + 1


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a document: doc_id, n_words, spans (first word, end) of hit words, and for each item with
    a match its longest verbatim match (item_id, at, n_words). Further blocks of items see the same rows
    once more, without a shuffle; the driver holds one block at a time, and rows are written between passes."""
    docs = docs_text(docs).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.lit(None).cast(SPANS), "matches": F.lit(None).cast(MATCHES)})
    blocks, n = _blocks(benchmark, block_words)
    for k in range(n):
        items = [(r["item_id"], r["text"]) for r in blocks.filter(F.col("block") == k).select("item_id", "text").collect()]  # of bounded size
        docs = _search(docs, TestSuffixes(items, window))
        if k + 1 < n:
            docs = materialize(docs, "searched")
    return docs.drop("text")


SPANS, MATCHES = "array<struct<first:long,end:long>>", "array<struct<item_id:string,at:long,n_words:long>>"


def _search(docs: DataFrame, test: TestSuffixes) -> DataFrame:
    def one(batch: pa.RecordBatch) -> dict:
        words = [letter_words(t) for t in batch["text"].to_pylist()]
        shard = ShardSuffixes(words, test)
        spans = [[(s["first"], s["end"]) for s in x or []] for x in batch["spans"].to_pylist()]
        found: dict[int, dict[str, dict[int, set]]] = {}
        for k, places in shard.matches(test):
            n = int(test.sizes[k])
            for d, at in zip(shard.doc[places].tolist(), shard.at[places].tolist(), strict=True):
                spans[d].append((at, at + n))
                for item, offset in test.owners[k]:
                    # Matches that continue each other lie on one diagonal.
                    found.setdefault(d, {}).setdefault(test.items[item], {}).setdefault(at - offset, set()).add((at, n))
        matches = [x or [] for x in batch["matches"].to_pylist()]
        for d, mine in found.items():
            matches[d] = matches[d] + [longest_match(item, diagonals) for item, diagonals in mine.items()]
        return {"doc_id": batch["doc_id"], "text": batch["text"], "n_words": shard.sizes, "spans": [merged(x) for x in spans], "matches": matches}

    return map_batches(docs, one, f"doc_id long, text string, n_words long, spans {SPANS}, matches {MATCHES}")


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "end": b} for a, b in out]


def longest_match(item: str, diagonals: dict[int, set]) -> dict:
    """The longest verbatim match of an item's suffixes in a document; the first of equally long ones."""
    best = (0, 0)
    for hits in diagonals.values():
        for s in merged([(at, at + n) for at, n in hits]):
            best = max(best, (s["end"] - s["first"], -s["first"]))
    return {"item_id": item, "at": -best[1], "n_words": best[0]}


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and matches."""
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return find_matches(docs, benchmark, window, block_words).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans", "matches",
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs; all columns are kept."""
    bad = materialize(contamination(docs, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(hinted(bad), docs["doc_id"].cast("long") == bad["__bad"], "left_anti")
