"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct five-word shingles, as 64-bit hashes; with fewer words, its whole word sequence is
the one element; without words it is empty and linked with nothing. Two documents link when 100 * intersection
>= 75 * union.

Tokens have one global order, rare ones first. Documents with a shared token among the first n - ceil(0.75 n) + l of
each, at least l of them, are candidates, and no link is missed for any l. Each document takes its own l: the
higher the estimated number of candidates in its basic prefix, the longer the prefix and the more shared tokens
are required; a pair must share as many as the lower l of the two, and where its own sizes ask for a larger overlap,
it must share them among the fewer tokens that this leaves at the start of each. The frequencies behind the order come from counts
within blocks of documents and steer cost only: any order gives the same links.

Work stays linear in large groups of copies. Equal sets are one class, joined through its first document. A first round
verifies only neighbours (by size) among those that share a token, which ties a group of near copies together; tokens
all of whose documents are by then in one component are done. A second round pairs what shares enough of the
remaining tokens and is not in one component yet. Only the sets of candidates travel, to be verified exactly.

Null texts count as empty. Rows without doc_id have no component. Rows that repeat a doc_id are one document with
several texts: each row has its own n_shingles, and the document links with whatever one of its texts links with. An empty
table gives no rows. Sets are of 64-bit hashes with coefficients drawn for each run; classes of equal sets have 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.components import connected_components
from precinct.blocks.shared import hinted, materialize
from precinct.llm.common import SEED, HashedWords, deal, dealt_schema, docs_text, drawn_seed, map_batches, mixed, packed, slices, undealt, unpacked

WORDS = 5
PERCENT = 75
#: Frequent tokens that the order knows; the others count as rare. A hint of bounded size, not a limit on results.
KNOWN = 1_000_000
#: Hashes a task holds when it counts frequent tokens, and prefix tokens when it deals them out.
BLOCK, DEALT = 500_000, 200_000
#: Text bytes that a task turns into shingles at a time: their numbers take some fifteen times as much.
PIECE = 1_000_000
#: Prefix tokens of a bucket, in which tokens meet: what a task handles at a time.
BUCKET = 200_000
MAX_EXTRA = 2
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_sets(texts: pa.Array, seed: int = SEED) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes. All texts' windows are hashed at once, those of one text are kept."""
    words = HashedWords(texts, seed)
    h = words.hashes
    wide = max(len(h) - WORDS + 1, 0)
    total = np.full(wide, WORDS, np.uint64)
    for k in range(WORDS):
        total += h[k : wide + k] * _POWERS[k]
    total = mixed(total)
    out, at = [], 0
    for n in words.counts.tolist():
        if n >= WORDS:
            s = np.sort(total[at : at + n - WORDS + 1])
            first = np.empty(len(s), bool)
            first[0] = True
            np.not_equal(s[1:], s[:-1], out=first[1:])
            out.append(s[first])
        elif n:
            out.append(mixed(np.array([n], np.uint64) + (h[at : at + n] * _POWERS[:n]).sum(dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist())


def _survey(docs: DataFrame, seed: int) -> DataFrame:
    """A row a document (doc_id, n, d1, d2) and rows (token, seen) of tokens that a block of documents shares."""
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("token", pa.int64()), ("seen", pa.int64())])

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def shared() -> pa.RecordBatch:
            every = np.sort(np.concatenate(held))
            held.clear()
            seen.clear()
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            count = np.diff(np.append(at, len(every)))
            often = count > 1
            return rows(token=every[at[often]].view(np.int64), seen=count[often])

        for b in batches:
            for piece in slices(b, PIECE):
                sets = shingle_sets(piece["text"], seed)
                digests = [_digest(s) for s in sets]
                for s, d in zip(sets, digests, strict=True):
                    if d not in seen and len(s):  # copies count once in a block
                        seen.add(d)
                        held.append(s)
                        size += len(s)
                yield rows(doc_id=piece["doc_id"].to_pylist(), n=[len(s) for s in sets], d1=[d[0] for d in digests], d2=[d[1] for d in digests])
                if size >= BLOCK:
                    size = 0
                    yield shared()
        if held:
            yield shared()

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, token long, seen long")


def prefix(s: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, int]:
    """(places of the prefix's tokens, in order, and required matches) of a set whose tokens were seen so often.

    The cost is estimated on the part that a document of the same size would be met in."""
    n = len(s)
    least, same = -(-PERCENT * n // 100), -(-2 * PERCENT * n // (100 + PERCENT))
    order = np.argsort(seen, kind="stable")
    cost = float(seen[order[: n - same + 1]].sum())
    need = min(least, 1 + min(MAX_EXTRA, int(np.log10(1 + cost / 10))))
    return order[: n - least + need], need


#: A prefix token's numbers while it is dealt out, as arrays in binary columns.
FIELDS = {"low": "<u4", "high": "<u4", "doc": "<i8", "n": "<u4", "need": "u1", "pos": "<u4"}
SHARED = "token long, doc long, n int, need int, size int, pos int, many boolean, last_doc long, last_n int, last_pos int"


def prefix_size(n, need):
    return n - (PERCENT * n + 99) // 100 + need


def _dealt(docs: DataFrame, known: np.ndarray, seen: np.ndarray, buckets: int, seed: int) -> DataFrame:
    """Prefix tokens dealt out by their hash, many to a row. Those that the order knows to be shared need not meet and go
    to buckets of their own, by where they come from, so a hot token is in no one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, turn = 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal turn
            token, doc, n, need, pos, common = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            turn += 1
            high, low = token >> np.uint64(32), token & np.uint64(0xFFFFFFFF)
            bucket = (high * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            target = np.where(common, buckets + turn % buckets, bucket)
            return deal(target, {"low": low, "high": bucket, "doc": doc, "n": n, "need": need, "pos": pos}, FIELDS)

        for b in batches:
            for piece in slices(b, PIECE):
                for d, s in zip(piece["doc_id"].to_pylist(), shingle_sets(piece["text"], seed), strict=True):
                    if len(s):
                        at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                        often = np.where(known[at] == s, seen[at], 0) if len(known) else np.zeros(len(s), np.int64)
                        places, need = prefix(s, often)
                        k = len(places)
                        held.append((s[places], np.full(k, d), np.full(k, len(s)), np.full(k, need), np.arange(k), often[places] > 0))
                        size += k
                    if size >= DEALT:
                        size = 0
                        yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, dealt_schema(FIELDS))


def _met(dealt: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """Prefix tokens that several documents have (or that are known to be shared): `SHARED`, with the one that comes
    before by (n, doc) among those with the same token, and whether more than two have it. A task handles one bucket at a
    time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(SHARED))

    def rows(x: dict, keep: np.ndarray, many: np.ndarray, last: np.ndarray | None) -> pa.RecordBatch:
        x = {f: v[keep] for f, v in x.items()}
        none = np.ones(len(keep), bool) if last is None else ~last[keep]
        before = (lambda v: np.zeros(len(keep), v.dtype)) if last is None else (lambda v: np.concatenate([v[:1], v[:-1]]))
        columns = {
            "token": x["high"].astype(np.int64) << 32 | x["low"].astype(np.int64), "doc": x["doc"], "n": x["n"], "need": x["need"],
            "size": prefix_size(x["n"].astype(np.int64), x["need"].astype(np.int64)), "pos": x["pos"], "many": many[keep],
            "last_doc": before(x["doc"]), "last_n": before(x["n"]), "last_pos": before(x["pos"]),
        }
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name].astype(f.type.to_pandas_dtype()), f.type, mask=none if f.name.startswith("last_") else None) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, x in undealt(batches, FIELDS):
            if bucket >= buckets:
                yield rows(x, np.arange(len(x["doc"])), np.ones(len(x["doc"]), bool), None)
                continue
            order = np.lexsort((x["doc"], x["n"], x["low"]))
            x = {f: v[order] for f, v in x.items()}
            same = x["low"][1:] == x["low"][:-1]
            last, more = np.concatenate([[False], same]), np.concatenate([same, [False]])
            # A third: one on both sides, or another step the same way.
            third = (last & more) | (last & np.concatenate([[False], last[:-1]])) | (more & np.concatenate([more[1:], [False]]))
            yield rows(x, np.flatnonzero(last | more), third, last)

    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, SHARED)


def _sizes_fit(a: str, b: str):
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """At least the overlap of two sets, from the sorted low bits of their hashes, repeats and all."""
    (a, na), (b, nb) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum())


def _compared(pairs: DataFrame, items: DataFrame, column: str, kind: str, overlap) -> DataFrame:
    """The pairs (a, b) whose overlap, by the given column of both documents' items, is enough."""
    of = lambda side: items.join(hinted(pairs.select(F.col(side).alias("doc")).distinct()), "doc", "left_semi")
    left = of("a").select(F.col("doc").alias("a"), F.col(column).alias("x"))
    right = of("b").select(F.col("doc").alias("b"), F.col(column).alias("y"))

    def one(batch: pa.RecordBatch) -> dict:
        good = []
        for x, y in zip(batch["x"], batch["y"], strict=True):
            x, y = (unpacked(v.as_buffer(), kind) for v in (x, y))
            both = overlap(x, y)
            good.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
        mask = pa.array(good, pa.bool_())
        return {"a": batch["a"].filter(mask), "b": batch["b"].filter(mask)}

    return map_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), one, "a long, b long")


def verified_links(docs: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """The pairs (a, b) that link. pairs is read more than once: pass it materialised.

    Two bytes a hash bound the overlap from above, which drops most pairs at a quarter of the bytes and no link; the
    whole hashes of the others decide."""
    ids = materialize(pairs.select("a").union(pairs.select("b")).distinct(), "candidates").withColumnRenamed("a", "doc_id")

    def sets(batch: pa.RecordBatch) -> dict:
        found = shingle_sets(batch["text"], seed)
        return {"doc": batch["doc_id"], "items": [packed(s, "<u8") for s in found], "low": [packed(np.sort(s.astype(np.uint16)), "<u2") for s in found]}

    items = materialize(map_batches(docs.join(hinted(ids), "doc_id", "left_semi"), sets, "doc long, items binary, low binary", PIECE), "candidate-sets")
    likely = materialize(_compared(pairs, items, "low", "<u2", overlap_bound), "likely-pairs")
    return _compared(likely, items, "items", "<u8", lambda x, y: len(np.intersect1d(x, y, assume_unique=True)))


def _neighbours(docs: DataFrame, known: np.ndarray, seen: np.ndarray, tokens: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(shared, pairs): the prefix tokens that have company, and the first round's pairs. tokens: of all sets.

    Of the documents with a token, each meets the next in size and the most central one of its size class: the one with
    the largest share of its prefix in common with others, as the original of a group of altered copies has."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, tokens * (100 - PERCENT) // 100 // BUCKET)
    shared = materialize(_met(_dealt(docs, known, seen, buckets, seed), buckets, max(tasks, buckets // 4)), "shared-tokens")
    near = shared.filter("last_doc is not null").select(F.col("last_doc").alias("a"), F.col("doc").alias("b"), F.col("last_n").alias("na"), F.col("n").alias("nb"), F.col("last_pos").alias("pa"), F.col("pos").alias("pb"))
    # Minima over tokens, not sorted groups. Where two documents have a token, they are neighbours already.
    central = shared.groupBy("doc").agg((F.count("*") / F.max("size")).alias("central"))
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT))).cast("int").alias("band")
    placed = materialize(shared.filter("many").join(hinted(materialize(central, "central")), "doc").select("token", band, "doc", "n", "pos", "central"), "placed")
    first = placed.groupBy("token", "band").agg(F.min(F.struct(-F.col("central"), F.col("doc"), F.col("n"), F.col("pos"))).alias("f"), F.count("*").alias("k")).filter("k > 1")
    star = placed.join(first, ["token", "band"]).select(F.col("f.doc").alias("a"), F.col("doc").alias("b"), F.col("f.n").alias("na"), F.col("n").alias("nb"), F.col("f.pos").alias("pa"), F.col("pos").alias("pb"))
    # Of a link's shared tokens, the first stands among the first n - overlap + 1 of both documents.
    overlap = F.ceil((F.col("na") + F.col("nb")) * PERCENT / (100 + PERCENT))
    early = (F.col("pa") <= F.col("na") - overlap + MAX_EXTRA) & (F.col("pb") <= F.col("nb") - overlap + MAX_EXTRA)
    pairs = near.union(star).filter("a <> b").filter(_sizes_fit("na", "nb")).filter(early).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return shared, materialize(pairs, "first-pairs")


def _remaining(shared: DataFrame, component: DataFrame, tested: DataFrame) -> DataFrame:
    """Pairs that share enough prefix tokens, are in different components and were not tested."""
    rows = shared.select("token", "doc", "n", "need", "pos").join(hinted(component), F.col("doc") == F.col("node"), "left")
    rows = materialize(rows.select("token", "doc", "n", "need", "pos", F.coalesce("component", "doc").alias("c")), "open-tokens")
    several = rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("token")
    rows = materialize(rows.join(several, "token"), "tokens-of-several")
    a = rows.select("token", *[F.col(x).alias(f"a_{x}") for x in ("doc", "n", "need", "pos", "c")])
    b = rows.select("token", *[F.col(x).alias(f"b_{x}") for x in ("doc", "n", "need", "pos", "c")])
    # For an overlap of at least `overlap`, the first `least` shared tokens stand among the first n - overlap + least of each.
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * PERCENT / (100 + PERCENT))
    least = F.least("a_need", "b_need")
    early = (F.col("a_pos") < F.col("a_n") - overlap + least) & (F.col("b_pos") < F.col("b_n") - overlap + least)
    met = a.join(b, (a["token"] == b["token"]) & (F.col("a_doc") < F.col("b_doc")) & (F.col("a_c") != F.col("b_c")) & _sizes_fit("a_n", "b_n") & early)
    enough = met.groupBy(F.col("a_doc").alias("a"), F.col("b_doc").alias("b")).agg(F.count("*").alias("k"), F.first(least).alias("need"))
    return enough.filter("k >= need").select("a", "b").join(tested, ["a", "b"], "left_anti")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links; itself without any)."""
    docs = docs_text(docs)
    seed = drawn_seed()
    survey = materialize(_survey(docs, seed), "shingle-survey")
    frequent = survey.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "token").limit(KNOWN).toArrow()
    known = frequent["token"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, seen = known[order], frequent["seen"].to_numpy()[order].astype(np.int32)
    every = survey.filter("token is null").select("doc_id", "n", "d1", "d2")
    classes = materialize(every.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    member = every.join(classes.filter("copies > 1").drop("copies"), ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    member = materialize(member, "members")
    copies = member.groupBy("doc_id").agg(F.bool_and(F.col("rep") != F.col("doc_id")).alias("copy"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    several = copies.filter("low <> high").select("doc_id").join(member, "doc_id").filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    several = materialize(several, "several-texts")
    firsts = docs.filter("doc_id is not null").join(hinted(copies.filter("copy").select("doc_id")), "doc_id", "left_anti")

    tokens = every.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared, pairs = _neighbours(firsts, known, seen, tokens, seed)
    links = materialize(verified_links(firsts, pairs, seed).union(several), "links")
    component = materialize(connected_components(links, "a", "b"), "components")
    rest = materialize(_remaining(shared, component, pairs), "second-pairs")
    more = materialize(verified_links(firsts, rest, seed), "links")
    if not more.isEmpty():
        component = materialize(connected_components(links.union(more), "a", "b"), "components")
    return member.join(hinted(component), F.col("rep") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the first of their component; all columns are kept."""
    go = materialize(jaccard_components(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__go")), "near-copies")
    return docs.join(hinted(go), docs["doc_id"].cast("long") == go["__go"], "left_anti")
