"""What the corpus operators share: reading tables, byte-level words, and the map over Arrow batches."""

from __future__ import annotations

import ctypes
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from precinct.blocks.shared import hinted, materialize

# Freed buffers go back to the system at once: workers live on from stage to stage.
pa.set_memory_pool(pa.system_memory_pool())

#: Byte table that lower-cases A-Z and leaves all else alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is neither letter nor digit becomes a space.
WORDS_ONLY = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch between the JVM and Python: both hold several.
ARROW_BYTES = 8_000_000


def docs_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null: empty), whatever other columns there are; Arrow batches are kept small."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def told_apart(docs: DataFrame) -> DataFrame:
    """docs_text of the rows with a doc_id, and `tx`: 0, or a hash of the text where an id has several texts. Rows equal in
    both are one document."""
    docs = docs_text(docs).filter("doc_id is not null")
    tx = F.xxhash64("text")
    several = docs.groupBy("doc_id").agg(F.min(tx).alias("low"), F.max(tx).alias("high")).filter("low <> high").select("doc_id", F.lit(True).alias("several"))
    several = materialize(several, "ids-with-several-texts")
    return docs.join(hinted(several), "doc_id", "left").select("doc_id", F.when(F.col("several"), tx).otherwise(F.lit(0).cast("long")).alias("tx"), "text")


def with_found(docs: DataFrame, keyed: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """All rows and columns of docs, and a struct `column` of what was found for (doc_id, tx), or null. No other column of docs
    is touched, whatever its name."""
    ids = materialize(keyed.filter("tx <> 0").select("doc_id").distinct(), "ids-with-several-texts")
    several = hinted(ids.select(F.struct(F.col("doc_id").alias("id"), F.lit(True).alias("several")).alias("__several")))
    right = hinted(found.select(F.struct(*found.columns).alias("__found")))
    id_ = F.col("__row.doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")).join(several, id_ == F.col("__several.id"), "left")
    tx = F.when(F.col("__several.several"), F.xxhash64(F.coalesce("__row.text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    joined = rows.join(right, (id_ == F.col("__found.doc_id")) & (tx == F.col("__found.tx")), "left")
    return joined.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns], F.col("__found").alias(column))


def remainder(n: int) -> F.Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n, F.lit(0))


def space_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def letter_words(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased, as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(WORDS_ONLY).split()


#: Text bytes that a task handles at a time: bounds its memory whatever Arrow's batches hold.
STEP_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text; a longer text is a piece of its own."""
    if "text" not in batch.schema.names:
        yield batch
        return
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, one: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str | StructType, most: int = STEP_BYTES) -> DataFrame:
    """mapInArrow where one(batch) gives columns by name as a dict (or several dicts), for about `most` bytes of text at a time."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema: StructType = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in slices(b, most):
                if piece.num_rows:
                    made = one(piece)
                    for columns in [made] if isinstance(made, dict) else made:
                        yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in arrow], schema=arrow)
        trimmed()

    return df.mapInArrow(run, spark_schema)


def trimmed() -> None:
    """Hand free memory back to the system (where the C library can): workers live on from stage to stage."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def as_arrow(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.Array):
        return x if x.type == kind else x.cast(kind)
    return pa.array(x, type=kind)


# -- Columns of numbers in binary, dealt out by the bucket ----------------------------------------------------------------


def packed(x: np.ndarray, kind: str) -> bytes:
    """The array with its bytes by significance, so that the zeros of small numbers stand together and compress."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def deal(target: np.ndarray, columns: dict[str, np.ndarray], fields: dict[str, str]) -> pa.RecordBatch:
    """A row a bucket of target: its entries of all columns, packed. fields: name and numpy type of each."""
    order = np.argsort(target, kind="stable")
    target = target[order]
    begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.empty(0, np.int64)
    spans = list(itertools.pairwise([*begin.tolist(), len(order)]))
    made = {f: [packed(x[a:b], fields[f]) for a, b in spans] for f, x in ((f, columns[f][order]) for f in fields)}
    schema = pa.schema([("bucket", pa.int32()), *[(f, pa.binary()) for f in fields]])
    return pa.RecordBatch.from_arrays([pa.array(target[begin], pa.int32()), *[pa.array(made[f], pa.binary()) for f in fields]], schema=schema)


def dealt_schema(fields: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{f} binary" for f in fields)


def undealt(batches: Iterator[pa.RecordBatch], fields: dict[str, str]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """(bucket, its columns), one bucket at a time, of rows sorted by the bucket."""
    now, held = None, []
    whole = lambda: {f: np.concatenate([unpacked(h[f], kind) for h in held]) for f, kind in fields.items()}
    for b in batches:
        for row in b.to_pylist():
            if row["bucket"] != now and held:
                yield now, whole()
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, whole()


# -- Words as hashes, without a Python object a word ---------------------------------------------------------------------

#: Words hashed at a time: what this needs stays in the processor's cache.
_PIECE = 1 << 15


#: Byte table: white space to 0, A-Z lower-cased, and 0 (which may stand in a word) to a byte that is free by then.
_CODES = bytes(0 if c == 32 or 9 <= c <= 13 else 65 if c == 0 else LOWER[c] for c in range(256))
def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser, so that sums spread over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Coefficients of word hashes by seed: one for every place in a word, as many as the longest word needed so far.
_COEFFICIENTS: dict[int, np.ndarray] = {}
#: Seed where hashes must be the same in every run; the others draw one of their own.
SEED = 0x243F6A8885A308D3


def drawn_seed() -> int:
    """A secret of the run (or of a task, if its hashes stay there): nobody can prepare words that collide."""
    return int.from_bytes(os.urandom(8), "little")


def _coefficients(seed: int, n: int) -> np.ndarray:
    have = _COEFFICIENTS.get(seed, np.empty(0, np.uint64))
    if len(have) < n:
        if len(_COEFFICIENTS) > 16:
            _COEFFICIENTS.clear()
        size = max(64, 1 << (n - 1).bit_length())
        have = _COEFFICIENTS[seed] = mixed(mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed))
    return have


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, ends) of a string column without nulls; text k is bytes[ends[k] : ends[k + 1]]."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, wide, len(texts) + 1, texts.offset * np.dtype(wide).itemsize).astype(np.int64) if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


class HashedWords:
    """The words between ASCII white space of a column of texts, A-Z lower-cased, as 64-bit hashes.

    A hash is the sum of a word's bytes times coefficients drawn for each place, so two words have one with a chance of about 2^-62,
    whatever they are, as long as the seed is not known to who wrote them.
    hashes: all words' in order; counts: words of each text; starts and raw: where in the bytes each word begins."""

    def __init__(self, texts: pa.Array, seed: int = SEED):
        self.seed = seed
        self.raw, ends = text_bytes(texts)
        self.codes = np.frombuffer(self.raw.tobytes().translate(_CODES), np.uint8)
        inside = self.codes != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = ends[:-1][ends[:-1] < len(inside)]
        first[heads] = inside[heads]  # a text begins a word whatever stands before it
        self.inside, self.starts, self.heads = inside, np.flatnonzero(first), heads
        self.bounds = np.searchsorted(self.starts, ends)
        self.counts = np.diff(self.bounds)
        self.hashes = mixed(self._sums())

    def stops(self) -> np.ndarray:
        """Where each word ends."""
        last = self.inside.copy()
        last[:-1] &= ~self.inside[1:]
        before = self.heads[self.heads > 0] - 1
        last[before] = self.inside[before]
        return np.flatnonzero(last) + 1

    def _sums(self) -> np.ndarray:
        s, n = self.starts, len(self.raw)
        out = np.empty(len(s), np.uint64)
        cut = np.searchsorted(s, np.arange(0, n, _PIECE))
        cut = np.unique(np.append(cut, len(s)))
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            a, b = int(s[i]), int(s[j]) if j < len(s) else n
            begins = s[i:j] - a
            sizes = np.diff(np.append(begins, b - a))
            place = np.arange(b - a) - np.repeat(begins, sizes)
            out[i:j] = np.add.reduceat(self.codes[a:b] * _coefficients(self.seed, int(sizes.max()))[place], begins)
        return out

    def again(self, which: np.ndarray, seed: int) -> np.ndarray:
        """Hashes of some of the words under another seed."""
        begins, sizes = self.starts[which], self.stops()[which] - self.starts[which]
        if not len(which):
            return np.empty(0, np.uint64)
        heads = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
        return mixed(np.add.reduceat(self.codes[np.repeat(begins, sizes) + place] * _coefficients(seed, int(sizes.max()))[place], heads))
