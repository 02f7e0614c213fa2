"""Token ids on disk: frequency ranks in byte-aligned variable-length coding with separate control bytes.

A file holds consecutive documents in ascending doc_id order: a header, the doc ids, their token counts, then the
control bytes (two bits a value: its length less one; four values a byte) and last the data bytes (little-endian,
1 to 4 bytes a value). A value is the rank of a token id by falling frequency over the whole corpus, ties by id; the
rank table is at most as large as the vocabulary. Decoding looks control bytes up in a table of four lengths and
gathers all values at once with numpy. Files are rows of a Parquet table in the shared folder, so that any
executor can write and read them; a file is cut at about `file_bytes`.

Null texts count as empty: an empty document holds just the end id. Null doc_ids come first. Rows that repeat are
each kept. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precinct.blocks.shared import materialize
from precinct.llm.common import HashedWords, docs_text, drawn_seed, map_batches

MAGIC = b"RVB1"
FILE_BYTES = 4_000_000
#: Length of each of the four values that a control byte describes.
LENGTHS = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)
_TOKENIZERS: dict = {}


def encode_values(v: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    v = np.ascontiguousarray(v, "<u4")
    size = 1 + (v > 0xFF) + (v > 0xFFFF).astype(np.int64) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    return (d[at] | d[at + 1] << 8 | d[at + 2] << 16 | d[at + 3] << 24) & MASKS[size] if n else np.empty(0, np.uint32)


def write_file(ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    null = np.array([i is None for i in ids], np.uint8)
    head = struct.pack("<4sQQQQ", MAGIC, len(ids), len(values), len(control), len(data))
    return head + null.tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes() + np.asarray(counts, "<u4").tobytes() + control + data


def read_file(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, token counts, values); raises ValueError for anything but a whole file."""
    magic, docs, n, nc, nd = struct.unpack_from("<4sQQQQ", blob)
    at = struct.calcsize("<4sQQQQ")
    if magic != MAGIC or len(blob) != at + docs * 13 + nc + nd:
        raise ValueError("not a whole id file")
    null = np.frombuffer(blob, np.uint8, docs, at)
    ids = np.frombuffer(blob, "<i8", docs, at + docs).tolist()
    counts = np.frombuffer(blob, "<u4", docs, at + 9 * docs).astype(np.int64)
    at += 13 * docs
    return [None if x else i for x, i in zip(null, ids, strict=True)], counts, decode_values(blob[at : at + nc], blob[at + nc :], n)


#: Stands between words in one call of the tokenizer: a byte with an id of its own that text hardly has. Fixed value.
SEPARATOR = "\x01"


class WordEncoder:
    """Whole texts to ids, by way of a memo of the words between white space.

    The tokenizer drops white space, never merges across it and lower-cases, so a text's ids are its words' ids in order.
    Words are known by two 64-bit hashes with coefficients that each task draws for itself; the memo is sorted arrays of hashes,
    places and lengths in a pool of ids, and starts anew when full. Texts that may hold a special token go to the tokenizer whole."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        (self.separator,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        self.seed, self.second = drawn_seed(), drawn_seed()
        self.known, self.check = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool, self.used = np.empty(1 << 16, self.wide), 0

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        """Each word's ids; many words take one call."""
        alone = {k for k, w in enumerate(words) if SEPARATOR in w}
        out: list = [None] * len(words)
        for k in alone:
            out[k] = np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, self.wide)
        rest = [k for k in range(len(words)) if k not in alone]
        for j in range(0, len(rest), 5000):
            part = rest[j : j + 5000]
            (e,) = self.tokenizer.encode_batch_fast([f" {SEPARATOR} ".join([words[k] for k in part])], add_special_tokens=False)
            ids = np.array(e.ids, self.wide)
            cut = np.flatnonzero(ids == self.separator)
            begins, ends = np.concatenate([[0], cut + 1]), np.append(cut, len(ids))
            for k, a, b in zip(part, begins.tolist(), ends.tolist(), strict=True):
                out[k] = ids[a:b]
        return out

    def _learn(self, hashes: np.ndarray, check: np.ndarray, words: list[str]) -> None:
        made = self._ids(words)
        size = np.array([len(x) for x in made], np.int64)
        at = self.used + np.cumsum(size) - size
        self.used += int(size.sum())
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(self.used, self.wide)])
        if made:
            self.pool[self.used - int(size.sum()) : self.used] = np.concatenate(made)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.at, self.size = known[order], np.concatenate([self.at, at])[order], np.concatenate([self.size, size])[order]
        self.check = np.concatenate([self.check, check])[order]

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        return at, self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids, little-endian, 2 bytes an id if the vocabulary allows."""
        if len(self.known) > self.most:
            self._forget()
        w = HashedWords(texts, self.seed)
        order = np.argsort(w.hashes)
        ranked = w.hashes[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(order) else np.empty(0, bool)
        every, one = ranked[new], order[new]
        at, there = self._places(every)
        check = w.again(one, self.second)
        if (self.check[at[there]] != check[there]).any():  # another word has the first hash: new coefficients
            self._forget()
            return self.encode(texts)
        missing = one[~there]
        raw, stops = w.raw.tobytes(), w.stops()
        self._learn(every[~there], check[~there], [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[missing].tolist(), stops[missing].tolist(), strict=True)])
        at, _ = self._places(every)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        at = at[which]
        size = self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.pool[np.repeat(self.at[at] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[w.bounds].tolist()
        out = [flat[a:b].tobytes() for a, b in itertools.pairwise(cuts)]
        if b"<|" in raw:
            for k, t in enumerate(texts.to_pylist()):
                if "<|" in t:
                    out[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.wide).tobytes()
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and vocabulary."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordEncoder(path)
    return _TOKENIZERS[path]


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (little-endian, 2 bytes an id if the vocabulary allows), wide (bytes an id)."""

    def one(batch: pa.RecordBatch) -> dict:
        e = encoder(path)
        end = np.array([end_id], e.wide).tobytes()
        ids = [x + end for x in e.encode(batch["text"])]
        return {"doc_id": batch["doc_id"], "ids": ids, "wide": [e.wide.itemsize] * len(ids)}

    return map_batches(docs_text(docs), one, "doc_id long, ids binary, wide int")


def rank_table(tokens: DataFrame) -> list[int]:
    """Token ids by falling frequency, ties by id: as many as there are distinct ids."""

    def one(batch: pa.RecordBatch) -> dict:
        wide = f"<u{batch['wide'][0].as_py()}"
        n = np.bincount(np.frombuffer(b"".join(batch["ids"].to_pylist()), wide))
        seen = np.flatnonzero(n)
        return {"id": seen, "n": n[seen]}

    counts = map_batches(tokens.select("ids", "wide"), one, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in sorted(counts.collect(), key=lambda r: (-r["n"], r["id"]))]


def write_id_files(docs: DataFrame, path: str, end_id: int, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, list[int]]:
    """(files, ranks). files: part, seq, start (ids of the part before this file), n_ids, file."""
    tokens = materialize(tokenize(docs, path, end_id), "token-ids")
    ranks = rank_table(tokens)
    rank_of = np.zeros(max(ranks, default=0) + 1, np.uint32)
    rank_of[np.array(ranks, np.int64)] = np.arange(len(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids, counts, parts, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held
            values = np.concatenate(parts)
            blob = write_file(ids, np.array(counts), values)
            out = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "start": [start], "n_ids": [len(values)], "file": [blob]}, schema=arrow)
            seq, start, held = seq + 1, start + len(values), 0
            for x in (ids, counts, parts):
                x.clear()
            return out

        for b in batches:
            for doc, raw, wide in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist(), b["wide"].to_pylist(), strict=True):
                values = rank_of[np.frombuffer(raw, f"<u{wide}")]
                ids.append(doc)
                counts.append(len(values))
                parts.append(values)
                held += 2 * len(values) + 12
                if held >= file_bytes:
                    yield flush()
        if ids:
            yield flush()

    arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("file", pa.binary())])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = tokens.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return materialize(ordered.mapInArrow(run, "part int, seq int, start long, n_ids long, file binary"), "id-files"), ranks


def read_id_files(files: DataFrame, ranks: list[int]) -> DataFrame:
    """doc_id, start, n_tokens, ids (array) and ids_crc32 of every document, from the files alone."""
    spark = files.sparkSession
    sums = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row a partition
    base, at = [], 0
    for part in sorted(sums):
        base.append((part, at))
        at += sums[part]
    based = files.join(F.broadcast(spark.createDataFrame(base, "part int, base long")), "part")
    id_of = np.array(ranks, "<u4")

    def one(batch: pa.RecordBatch) -> Iterator[dict]:
        for base, start, blob in zip(batch["base"].to_pylist(), batch["start"].to_pylist(), batch["file"].to_pylist(), strict=True):
            docs, counts, values = read_file(blob)
            ids = id_of[values]
            ends = np.cumsum(counts)
            begins = ends - counts
            yield {
                "doc_id": docs, "start": base + start + begins, "n_tokens": counts,
                "ids": pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int32))),
                "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)],
            }

    return map_batches(based.select("base", "start", "file"), one, "doc_id long, start long, n_tokens long, ids array<int>, ids_crc32 long")
