"""Substring dedup by content-defined chunking.

A gear rolling hash over the last 16 bytes decides where a text is cut: before a word whose hash is the least of some `WINDOW` words
in a row (inside very long words, before an eighth of the characters, by their hash). So every such stretch has a cut, any `MIN_WORDS` words
hold a whole chunk, and an insertion moves only the cuts beside it. The variable chunks meet by digest; the
occurrence that is first by (doc_id, place) is the original and the others are copies. Copies that follow each other in a
document form a run as long as one original, at one distance, continues it. A run is compared with the bytes beside its
original, which gives the passage's true ends, in whole words; runs of one original that meet by that are one passage. A passage of
at least `MIN_WORDS` words (or `MIN_BYTES` bytes, for texts without spaces) is a repeat and goes; shorter ones are idiom
and stay, whatever stands beside them.

Chunks are dealt out by digest in packed blocks. A task sends one chunk for each digest and `HELD` chunks, so a
digest that a large part of the corpus has makes no large group; what it holds back are copies anyhow, whose original is
looked up afterwards.

Cuts fall between characters. Null and empty texts have no chunks and stay as they are. Rows that repeat doc_id and text
are one document; other texts under the same doc_id are documents of their own. Rows without doc_id stay as they are. An
empty table gives no rows. Digests have 64 bits and those of the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import hinted, materialize
from precinct.llm.common import deal, dealt_schema, map_batches, slices, told_apart, undealt, with_found

WINDOW = 16
MIN_CHUNK = 8
#: Words of more bytes than this may be cut inside.
LONG_WORD = 64
MAX_CHUNK = 250
MIN_WORDS = 50
MIN_BYTES = 600
#: Bytes beside a run that are compared: more than a passage can reach beyond its whole chunks.
CONTEXT = 320
#: Chunks that a task holds before it deals them out, chunks of a bucket, and about the bytes of one.
HELD, BUCKET, CHUNK_BYTES = 500_000, 200_000, 40
SPANS = "array<struct<begin:int,end:int>>"

#: Gear table: a fixed pseudo-random number for each byte, from a linear congruential rule.
GEAR = np.empty(256, np.uint32)
_x = 12345
for _k in range(256):
    for _ in range(4):
        _x = (_x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
    GEAR[_k] = _x >> 32
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 16 bytes up to each place: the sum of gear[byte] << distance, by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def _over_windows(x: np.ndarray, wide: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `wide` places in a row, by doubling."""
    out, have = x, 1
    while 2 * have <= wide:
        out = pick(out[:-have], out[have:])
        have *= 2
    return pick(out[: len(x) - wide + 1], out[wide - have : wide - have + len(x) - wide + 1]) if have < wide else out


def cut_places(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Ends of the chunks of a text's UTF-8 bytes; the last is its length."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    ends = np.empty(0, np.int64)
    space = _IS_SPACE[data]
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if n > LONG_WORD or len(starts) >= window:
        h = rolling(data)
        starts = starts[starts >= 16]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        for x, y in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] > LONG_WORD].tolist():
            inside = np.arange(max(x + 1, 16), y)
            starts = np.union1d(starts, inside[(h[inside - 1] >> np.uint32(8) & np.uint32(7) == 0) & ((data[inside] & 0xC0) != 0x80)])
        if (k := len(starts)) >= window:
            at = h[starts - 1]
            least = np.zeros(k + window - 1, np.uint32)
            least[window - 1 : k] = _over_windows(at, window, np.minimum)
            ends = starts[_over_windows(least, window, np.maximum) == at]
            ends = ends[np.diff(ends, prepend=-MIN_CHUNK) >= MIN_CHUNK]  # a rule that looks back one cut only
    ends = np.append(ends, n)
    begins = np.concatenate([[0], ends[:-1]])
    if (long := ends - begins > MAX_CHUNK).any():
        more = np.concatenate([np.arange(b + MAX_CHUNK, e, MAX_CHUNK) for b, e in zip(begins[long], ends[long], strict=True)])
        while (inside := (data[more] & 0xC0) == 0x80).any():
            more[inside] += 1
            more = more[more < n]
        ends = np.union1d(ends, more)
    return ends


FIELDS = {"h": "<u8", "doc": "<i8", "tx": "<i8", "at": "<u4", "size": "<u2", "first_doc": "<i8", "first_tx": "<i8", "first_at": "<u4"}
COPIES = "held boolean, doc long, tx long, at int, size int, first_doc long, first_tx long, first_at int"


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """Chunks by bucket of their digest; copies of a digest that the task has already sent go to buckets of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, turn = 0, TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            nonlocal turn
            turn += 1
            digests = np.frombuffer(b"".join(x[0] for x in held), "<u8").reshape(-1, 2)
            h, bucket = np.ascontiguousarray(digests[:, 0]), ((digests[:, 1] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            doc, tx, at, size = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3, 4))
            held.clear()
            order = np.lexsort((at, tx, doc, bucket, h))
            h, bucket, doc, tx, at, size = (v[order] for v in (h, bucket, doc, tx, at, size))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            columns = {"h": np.where(new, h, 0), "doc": doc, "tx": tx, "at": at, "size": size, "first_doc": np.where(new, 0, doc[first]), "first_tx": np.where(new, 0, tx[first]), "first_at": np.where(new, 0, at[first])}
            return deal(np.where(new, bucket, buckets + turn % buckets), columns, FIELDS)

        for b in batches:
            for piece in slices(b):
                for doc, tx, text in zip(piece["doc_id"].to_pylist(), piece["tx"].to_pylist(), piece["text"].to_pylist(), strict=True):
                    raw = text.encode("utf-8")
                    ends = cut_places(np.frombuffer(raw, np.uint8))
                    k = len(ends)
                    if k:
                        begins = np.concatenate([[0], ends[:-1]])
                        digests = b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
                        held.append((digests, np.full(k, doc), np.full(k, tx), begins, ends - begins))
                        size += k
                    if size >= HELD:
                        size = 0
                        yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, dealt_schema(FIELDS))


def _copies(dealt: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """`COPIES`: every chunk that isn't the first with its digest, with the first; for those held back by a task (held), with the
    one that was sent in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, x in undealt(batches, FIELDS):
            if bucket < buckets:
                order = np.lexsort((x["at"], x["tx"], x["doc"], x["h"]))
                x = {f: v[order] for f, v in x.items()}
                new = np.concatenate([[True], x["h"][1:] != x["h"][:-1]])
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                x |= {f"first_{f}": x[f][first] for f in ("doc", "tx", "at")}
                x = {f: v[~new] for f, v in x.items()}
            n = len(x["doc"])
            kinds = {"held": pa.bool_(), "doc": pa.int64(), "tx": pa.int64(), "at": pa.int32(), "size": pa.int32(), "first_doc": pa.int64(), "first_tx": pa.int64(), "first_at": pa.int32()}
            x["held"] = np.full(n, bucket >= buckets)
            yield pa.RecordBatch.from_arrays([pa.array(x[f].astype(k.to_pandas_dtype()), k) for f, k in kinds.items()], names=list(kinds))

    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, COPIES)


def chunk_copies(docs: DataFrame) -> DataFrame:
    """doc, tx, at, size, first_doc, first_tx, first_at: every chunk that isn't the first with its digest. docs: told_apart."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, size // CHUNK_BYTES // BUCKET)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(_copies(_dealt(docs, buckets), buckets, max(tasks, buckets // 4)), "chunk-copies")
    sent, back = found.filter("not held").drop("held"), found.filter("held").drop("held")
    true = sent.select(*[F.col(f).alias(f"s_{f}") for f in ("doc", "tx", "at")], F.struct("first_doc", "first_tx", "first_at").alias("true"))
    on = (F.col("first_doc") == F.col("s_doc")) & (F.col("first_tx") == F.col("s_tx")) & (F.col("first_at") == F.col("s_at"))
    back = back.join(true, on, "left").select("doc", "tx", "at", "size", *[F.coalesce(F.col(f"true.{f}"), F.col(f)).alias(f) for f in ("first_doc", "first_tx", "first_at")])
    return sent.union(back)


def runs_of(copies: list[dict]) -> list[dict]:
    """Runs of copies that follow each other as their originals do: begin, end, and the original's doc and tx and how far on it is."""
    runs: list[dict] = []
    for c in sorted(copies, key=lambda c: c["at"]):
        of = {"doc": c["first_doc"], "tx": c["first_tx"], "off": c["first_at"] - c["at"]}
        end = c["at"] + c["size"]
        if runs and runs[-1]["end"] == c["at"] and all(runs[-1][f] == x for f, x in of.items()):
            runs[-1]["end"] = end
        else:
            runs.append({"begin": c["at"], "end": end} | of)
    return runs


RUN = "begin int, end int, first_doc long, first_tx long, off int"


def _runs(copies: DataFrame) -> DataFrame:
    by_doc = copies.groupBy("doc", "tx").agg(F.collect_list(F.struct("at", "size", "first_doc", "first_tx", "first_at")).alias("copies"))

    def one(batch: pa.RecordBatch) -> dict:
        rows = [(d, t, r) for d, t, c in zip(batch["doc"].to_pylist(), batch["tx"].to_pylist(), batch["copies"].to_pylist(), strict=True) for r in runs_of(c)]
        of = {"begin": "begin", "end": "end", "first_doc": "doc", "first_tx": "tx", "off": "off"}
        return {"doc": [x[0] for x in rows], "tx": [x[1] for x in rows], **{f: [r[g] for _, _, r in rows] for f, g in of.items()}}

    return map_batches(by_doc, one, f"doc long, tx long, {RUN}")


def _beside(runs: DataFrame, after: bool) -> DataFrame:
    """The place in the original where a run begins, or (after) ends."""
    at = F.col("end" if after else "begin") + F.col("off")
    return runs.withColumns({"o_doc": F.col("first_doc"), "o_tx": F.col("first_tx"), "o_at": at.cast("int")})


def _contexts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """o_doc, o_tx, o_at, after, bytes: up to CONTEXT bytes before or after each wanted place."""
    side = lambda after: _beside(runs, after).select("o_doc", "o_tx", "o_at", F.lit(after).alias("after"))
    wanted = side(False).union(side(True)).distinct().groupBy(F.col("o_doc").alias("doc_id"), F.col("o_tx").alias("tx")).agg(F.collect_list(F.struct("o_at", "after")).alias("want"))
    found = docs.join(hinted(materialize(wanted, "wanted-contexts")), ["doc_id", "tx"]).dropDuplicates(["doc_id", "tx"])

    def one(batch: pa.RecordBatch) -> dict:
        of = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["want"]).to_numpy(zero_copy_only=False))
        at, after = batch["want"].flatten().flatten()
        places, sides, bounds = at.to_numpy(), after.to_numpy(zero_copy_only=False), np.searchsorted(of, np.arange(batch.num_rows + 1))
        out = []
        for k in range(batch.num_rows):
            raw, mine = batch["text"][k].as_py().encode("utf-8"), slice(bounds[k], bounds[k + 1])
            out += [raw[x : x + CONTEXT] if right else raw[max(0, x - CONTEXT) : x] for x, right in zip(places[mine].tolist(), sides[mine].tolist(), strict=True)]
        rows = pa.array(of)
        return {"o_doc": batch["doc_id"].take(rows), "o_tx": batch["tx"].take(rows), "o_at": at, "after": after, "bytes": pa.array(out, pa.binary())}

    return map_batches(found.select("doc_id", "tx", "text", "want"), one, "o_doc long, o_tx long, o_at int, after boolean, bytes binary")


def _same(a: bytes, b: bytes) -> int:
    """Length of the common start."""
    n = min(len(a), len(b))
    x = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)) if n else []
    return int(x[0]) if len(x) else n


_SPACE = frozenset(b" \t\n\x0b\x0c\r")


def _whole(mine: bytes, other: bytes) -> int:
    """Length of the common start; a word that ends there in one text but goes on in the other isn't common."""
    n = _same(mine, other)
    if (n == len(mine) or mine[n] in _SPACE) and n < len(other) and other[n] not in _SPACE:
        while n and mine[n - 1] not in _SPACE:
            n -= 1
    return n


def passages(raw: bytes, runs: list[dict], min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> tuple[list[dict], list[int]]:
    """(spans, originals' documents) of the repeats: runs with their true ends, in whole words. Runs of one original are one
    where they meet; each passage must be long enough by itself."""
    of_original: dict[tuple, list[list[int]]] = {}
    for r in sorted(runs, key=lambda r: r["begin"]):
        before, after = raw[: r["begin"]][-CONTEXT:][::-1], raw[r["end"] : r["end"] + CONTEXT]
        a = r["begin"] - _whole(before, (r["before"] or b"")[::-1])
        b = r["end"] + _whole(after, r["after"] or b"")
        mine = of_original.setdefault((r["doc"], r["tx"], r["off"]), [])
        if mine and a <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], b)
        else:
            mine.append([a, b])
    out, firsts = [], set()
    for (doc, *_), a, b in [(key, a, b) for key, spans in of_original.items() for a, b in spans]:
        # Words that are only in part the same stay, unless the passage is one long word; then whole characters count.
        x, y = a, b
        while 0 < x < y and raw[x - 1] not in _SPACE and raw[x] not in _SPACE:
            x += 1
        while x < y < len(raw) and raw[y - 1] not in _SPACE and raw[y] not in _SPACE:
            y -= 1
        if x >= y:
            x, y = a, b
            while x < len(raw) and raw[x] & 0xC0 == 0x80:
                x += 1
            while 0 < y < len(raw) and raw[y] & 0xC0 == 0x80:
                y -= 1
        if y - x >= min_bytes or len(raw[x:y].split()) >= min_words:
            out.append((x, y))
            firsts.add(doc)
    joined: list[dict] = []
    for x, y in sorted(out):
        if joined and x <= joined[-1]["end"]:
            joined[-1]["end"] = max(joined[-1]["end"], y)
        else:
            joined.append({"begin": x, "end": y})
    return joined, sorted(firsts)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, tx, runs: for the documents (told_apart) that have chunks which are copies, with the bytes beside the originals."""
    runs = materialize(_runs(chunk_copies(docs)), "runs-of-copies")
    beside = materialize(_contexts(docs, runs), "contexts")
    for after, name in ((False, "before"), (True, "after")):
        c = beside.filter(F.col("after") == after).select("o_doc", "o_tx", "o_at", F.col("bytes").alias(name))
        runs = _beside(runs, after).join(c, ["o_doc", "o_tx", "o_at"], "left").drop("o_doc", "o_tx", "o_at")
    run = F.struct("begin", "end", F.col("first_doc").alias("doc"), F.col("first_tx").alias("tx"), "off", "before", "after")
    return runs.groupBy(F.col("doc").alias("doc_id"), "tx").agg(F.collect_list(run).alias("runs"))


def cut_out(text: str, spans: list[dict]) -> str:
    raw, out, at = text.encode("utf-8"), [], 0
    for s in spans:
        out.append(raw[at : s["begin"]])
        at = s["end"]
    return b"".join([*out, raw[at:]]).decode("utf-8")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, text without its repeated passages, has_repeats, removed_bytes, spans, first_doc_ids (who has the originals)."""
    keyed = told_apart(docs)
    found = materialize(repeated_runs(keyed), "repeated-runs")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = with_found(plain, keyed, found, "found").select("doc_id", "text", F.col("found.runs").alias("runs"))

    def one(batch: pa.RecordBatch) -> dict:
        texts = batch["text"].to_pylist()
        made = [passages(t.encode("utf-8"), r, min_words, min_bytes) if r else ([], []) for t, r in zip(texts, batch["runs"].to_pylist(), strict=True)]
        return {
            "doc_id": batch["doc_id"], "text": [cut_out(t, s) if s else t for t, (s, _) in zip(texts, made, strict=True)], "has_repeats": [bool(s) for s, _ in made],
            "removed_bytes": [sum(x["end"] - x["begin"] for x in s) for s, _ in made], "spans": [s for s, _ in made], "first_doc_ids": [f for _, f in made],
        }

    return map_batches(joined, one, f"doc_id long, text string, has_repeats boolean, removed_bytes long, spans {SPANS}, first_doc_ids array<long>")
