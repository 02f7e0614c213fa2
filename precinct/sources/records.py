"""Records of CSV files whose quoted fields may hold line breaks, with every file split between tasks.

Whether a split of a file begins inside a quoted field is told by the parity of all quotes before it. A first pass counts each split's
quotes, a running sum over a row a split gives the parity at its start, and the second pass cuts records at their true ends. A record
that crosses splits leaves a piece in each; the pieces, two a split at most, are put together and join the others.

A quote opens or closes a quoted stretch wherever it stands, and two inside one are a quote. The first line of a file is its
header. Blank lines between records are skipped; a line break inside a field becomes "\\n" however it was written. A file that
ends inside a quoted field ends its last record there. Empty files have no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from precinct.blocks.shared import materialize, small_enough

RECORD, HEAD, TAIL = 0, 1, 2  # whole; what a record goes on with in a later split; where a record begins that goes on


def fields_of(record: str) -> list[str]:
    """The fields; those without a quote lose the white space around them."""
    if '"' not in record:
        return [x.strip() for x in record.split(",")]
    out, field, quoted = [], [], False
    pieces = record.split('"')  # outside and inside a quoted stretch by turns
    for k, piece in enumerate(pieces):
        if k % 2:
            quoted = True
            field.append(piece)
        elif not piece and 0 < k < len(pieces) - 1:
            field.append('"')  # two quotes side by side
        else:
            first, *more = piece.split(",")
            field.append(first)
            for x in more:
                text = "".join(field)
                out.append(text if quoted else text.strip())
                field, quoted = [x], False
    text = "".join(field)
    return [*out, text if quoted else text.strip()]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def _splits(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, bool]]:
    """(values of names, lines, whether they begin a split): a task reads its splits one after the other."""
    now = None
    for batch in batches:
        at = 0
        keys = list(zip(*(batch[c].to_pylist() for c in names), strict=True))
        while at < len(keys):
            stop = at + 1
            while stop < len(keys) and keys[stop] == keys[at]:
                stop += 1
            yield keys[at], batch.slice(at, stop - at), keys[at] != now
            now, at = keys[at], stop


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(key: tuple, odd: int, head: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([odd % 2 == 1]), pa.array([head], pa.string())], names=["file", "block", "odd", "head"])

    last, odd, head = None, 0, None
    for key, batch, begins in _splits(batches, ["file", "block"]):
        if begins:
            if last:
                yield row(last, odd, head)
            last, odd, head = key, 0, None
        lines = batch["line"]
        if begins and key[1] == 0:
            head, lines = lines[0].as_py().removesuffix("\r"), lines[1:]
        odd += pc.sum(pc.count_substring(lines, '"')).as_py() or 0
    if last:
        yield row(last, odd, head)


def _cut(whole: bool):
    """Records of the splits, or (not whole) the pieces of those that cross into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, inside, going, kind = None, False, [], RECORD
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["file", "block", "kind", "fields", "piece"])

        def ended(open_: bool) -> None:
            """The lines in hand are a record, or a piece of one."""
            if not going:
                return
            text = "\n".join(going)
            going.clear()
            if kind == HEAD or open_:
                if not whole:
                    out.append((*last, kind if kind == HEAD else TAIL, None, text))
            elif whole:
                out.append((*last, RECORD, fields_of(text), None))

        for key, batch, begins in _splits(batches, ["file", "block", "starts_inside"]):
            lines = batch["line"].to_pylist()
            if begins:
                ended(inside)
                last, inside = key[:2], key[2]
                kind = HEAD if inside else RECORD
                lines = lines[1:] if key[1] == 0 else lines
            for line in lines:
                line = line.removesuffix("\r")
                if not inside and not line.strip():
                    continue
                going.append(line)
                if line.count('"') % 2:
                    inside = not inside
                if not inside:
                    ended(False)
                    kind = RECORD
            yield flush()
        ended(inside)
        yield flush()

    return run


_CUT = "file string, block long, kind int, fields array<string>, piece string"


@F.pandas_udf(ArrayType(StringType()))
def _fields(text):
    return text.map(fields_of)


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(file, fields) of every record, and (file, head) of every file: its header line.

    What is broadcast is a hash of each split that begins inside a field: 16 bytes for a split, a hundredth of a millionth of the input."""
    lines = _lines(spark, path)
    splits = materialize(lines.mapInArrow(_counted, "file string, block long, odd boolean, head string"), "splits")
    by_file = Window.partitionBy("file").orderBy("block")  # a row a split
    before = F.coalesce(F.sum(F.col("odd").cast("int")).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parity = splits.select("file", "block", (before % 2 == 1).alias("starts_inside"), ((before + F.col("odd").cast("int")) % 2 == 1).alias("ends_inside"))
    key = F.xxhash64("file", "block")
    inside = parity.filter("starts_inside").select(key.alias("k"), F.lit(True).alias("starts_inside"))
    border = parity.filter("starts_inside or ends_inside").select(key.alias("k"), "starts_inside")
    inside, border = materialize(inside, "inside"), materialize(border, "borders")
    if not (small_enough(inside) and small_enough(border)):
        raise ValueError("too many splits begin inside a quoted field: raise spark.sql.files.maxPartitionBytes")
    named = lines.withColumn("k", key)
    marked = named.join(F.broadcast(inside), "k", "left").withColumn("starts_inside", F.coalesce("starts_inside", F.lit(False)))
    records = marked.select("file", "block", "starts_inside", "line").mapInArrow(_cut(True), _CUT).select("file", "fields")
    at_border = named.join(F.broadcast(border), "k").select("file", "block", "starts_inside", "line")
    pieces = at_border.mapInArrow(_cut(False), _CUT).select("file", "block", "kind", "piece")
    order = Window.partitionBy("file").orderBy("block", "kind")  # two rows a split
    numbered = pieces.withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    glued = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "piece"))).alias("p"))
    crossing = glued.select("file", _fields(F.array_join("p.piece", "\n")).alias("fields"))
    return records.union(crossing), splits.filter("head is not null").select("file", F.ltrim("head", F.lit("\ufeff")).alias("head"))
