"""Media columns as interleaved document sequences.

`interleave` parses HTML to one ordered array of structs a document: text pieces and media references, each with its
position; a reference carries the digest that names its payload and the caption that stands with it. `store_media`
keeps payloads as 8-bit grey images (binary PGM, 24 samples a row) under their SHA-256. `resolve` joins references to
the stored images by digest, so that positions and captions stay with the features read from them.

Null HTML or text counts as empty: its sequence is empty. References without a stored payload keep null features.
Equal payloads are resolved by one digest, however often they are referred to; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from precinct.blocks.shared import materialize
from precinct.llm.common import docs_text, map_batches

SIDE = 24
TILE = SIDE * SIDE  # a payload is padded to a multiple of this many bytes
SEQUENCE = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
SKIPPED = {"script", "style", "title", "nav"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "blockquote", "br", "pre", "figure"}


class Sequence(HTMLParser):
    """Text and media references in the order in which they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def end_text(self) -> None:
        if text := "".join(self.words).strip():
            self.add("text", text=text)
        self.words = []

    def add(self, kind: str, **more) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "digest": None, "caption": None} | more)

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        if tag in BLOCKS:
            self.end_text()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            named = dict(attrs)
            if src := named.get("src"):
                self.end_text()
                self.add("media", digest=src.removeprefix("sha256:"), caption=named.get("alt"))
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        if tag in BLOCKS:
            self.end_text()
        if tag == "figcaption" and self.caption is not None:
            for k in self.figure or []:
                self.items[k]["caption"] = "".join(self.caption).strip()
            self.caption = None
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.skip:
            (self.words if self.caption is None else self.caption).append(data)


def parse_sequence(html: str) -> list[dict]:
    parser = Sequence()
    parser.feed(html)
    parser.close()
    parser.end_text()
    return parser.items


def interleave(pages: DataFrame, html: str = "html") -> DataFrame:
    """Every row's other columns, whatever their names, and `sequence` in place of the HTML and of a column of that name."""
    others = [c for c in pages.columns if c not in (html, "sequence")]
    rows = pages.select(F.struct(F.lit(0).alias("__any"), *[F.col(f"`{c}`") for c in others]).alias("__row"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("text"))
    schema = StructType([rows.schema["__row"], *_parse_datatype_string(f"sequence {SEQUENCE}")])

    def one(batch: pa.RecordBatch) -> dict:
        return {"__row": batch["__row"], "sequence": [parse_sequence(x) for x in batch["text"].to_pylist()]}

    return map_batches(rows, one, schema).select(*[F.col(f"__row.`{c}`").alias(c) for c in others], "sequence")


def media_references(sequences: DataFrame) -> DataFrame:
    """A row for every media reference: the other columns, position, digest, caption."""
    others = [c for c in sequences.columns if c != "sequence"]
    return sequences.select(*others, F.explode("sequence").alias("m")).filter("m.kind = 'media'").select(*others, "m.position", "m.digest", "m.caption")


def padded(raw: Column) -> Column:
    """The bytes, then bytes 255 up to a positive multiple of TILE."""
    n = F.octet_length(raw)
    return F.concat(raw, F.unhex(F.repeat(F.lit("FF"), F.greatest(F.ceil(n / TILE), F.lit(1)).cast("int") * TILE - n)))


def store_media(payloads: DataFrame) -> DataFrame:
    """Write (digest, payload) as images to the shared folder; returns (digest, media) read back."""
    rows = (F.octet_length("payload") / SIDE).cast("int").cast("string")
    head = F.encode(F.concat(F.lit(f"P5\n{SIDE} "), rows, F.lit("\n255\n")), "UTF-8")
    return materialize(payloads.select("digest", F.concat(head, F.col("payload")).alias("media")), "media")


def read_image(media: bytes) -> bytes:
    """The samples of a binary PGM; raises ValueError for anything else."""
    kind, shape, top, samples = media.split(b"\n", 3)
    wide, high = map(int, shape.split())
    if kind != b"P5" or top != b"255" or len(samples) != wide * high:
        raise ValueError("not an 8-bit grey image")
    return samples


def average_hash(samples: bytes) -> str:
    """64 bits: which of the 8 x 8 fields of the mean tile are lighter than their median."""
    tile = np.frombuffer(samples, np.uint8).reshape(-1, SIDE, SIDE).mean(axis=0)
    field = tile.reshape(8, 3, 8, 3).mean(axis=(1, 3))
    return np.packbits(field > np.median(field)).tobytes().hex()


def media_features(stored: DataFrame) -> DataFrame:
    """A row for every digest: what the stored bytes, read back, hold."""

    def one(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
        for media in batch["media"].to_pylist():
            samples = read_image(media)
            for k, v in zip(out, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), average_hash(samples)), strict=True):
                out[k].append(v)
        return out | {"digest": batch["digest"]}

    rows = map_batches(stored, one, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns[1:]])


def resolve(references: DataFrame, stored: DataFrame) -> DataFrame:
    """References with the features of their payloads; positions and captions as they were."""
    return references.join(media_features(stored), "digest", "left")


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Every document as an interleaved sequence: its text, then its bytes as a stored image, resolved by digest."""
    text = docs_text(docs)
    raw = F.encode("text", "UTF-8")
    stored = store_media(text.select(padded(raw).alias("payload")).select(F.sha2("payload", 256).alias("digest"), "payload"))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = F.concat(
        F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), F.sha2(padded(raw), 256),
        F.lit('"><figcaption>bytes of document '), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("</figcaption></figure></article>"),
    )
    pages = text.select("doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), html.alias("html"))
    return resolve(media_references(interleave(pages)), stored)
