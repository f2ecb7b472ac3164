"""Media columns: interleaved document sequences.

A page's HTML becomes an ordered array of structs, text blocks and media references with their
captions.  Payloads are 8-bit grey PNG images, 64 samples a row, in a binary column of a table in the shared
folder, keyed by the digest of what they hold; a join on the digest resolves the references.  A reference
keeps its position and caption whether or not its payload is there.

A payload is the bytes of a text, filled with zeros to a positive multiple of 64.  Storing is lossless:
what is described is what was read back from the table.

At scale: a task stores a text once, so a common text is a few rows of the table.  Stored payloads are read
and described where they lie; only descriptions, made one a digest with map-side partial sums, are moved to
the references, so payloads are never shuffled.  Descriptions are written first, so that the join that hands
them out stands alone and adaptive execution can split a common digest.  ``payloads_of`` joins the payloads
themselves, for those who want them beside their references.

Nulls: a null text is an empty payload, a null page an empty sequence, a null or foreign reference has no
payload.  Malformed HTML gives what could be read; texts of any length are whole.  Repeated rows and equal
texts share one stored payload and give repeated rows.  Empty tables give empty results.  Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm._common import Scratch, rows_of

#: Samples in a row of a stored image; payloads are multiples of it.
ROW = 64
#: Digests that a task remembers, so as to store a text once.
REMEMBERED = 100_000
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = ("img", "video", "audio", "source", "embed")
SILENT_TAGS = ("script", "style", "template", "noscript")
BLOCK_TAGS = ("address", "article", "aside", "blockquote", "body", "div", "dd", "dl", "dt", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul")


# -- stored form ---------------------------------------------------------------------------------


def payload_of(raw: bytes) -> bytes:
    """The bytes, filled with zeros to a positive multiple of a row."""
    return raw + b"\0" * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def store(payload: bytes) -> bytes:
    """A grey PNG whose samples are the payload."""
    lines = np.zeros((len(payload) // ROW, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(lines), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def read_back(media: bytes) -> bytes:
    """The samples of a PNG that ``store`` wrote."""
    if media[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, body = 8, []
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            body.append(data)
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """An 8 x 8 average hash of the image: whether each field is brighter than the whole, as 16 hex digits."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    rows = len(image)
    fields = image.reshape(rows, 8, ROW // 8).sum(axis=2, dtype=np.int64)
    from_row = np.arange(8) * rows // 8
    to_row = np.maximum(from_row + 1, np.arange(1, 9) * rows // 8)
    up_to = np.vstack([np.zeros((1, 8), np.int64), np.cumsum(fields, axis=0)])
    sums = up_to[to_row] - up_to[from_row]
    size = ((to_row - from_row) * (ROW // 8))[:, None]
    bits = sums * (rows * ROW) > int(fields.sum()) * size
    return np.packbits(bits.ravel()).tobytes().hex()


_STORED = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_DESCRIBED = pa.schema([("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _rows(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), schema.types, strict=True)], schema=schema)


def store_texts(texts: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The table of payloads: digest of the text, its bytes, media (the PNG); a digest may have several equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for (cells,) in rows_of(batch, 64):
                made = []
                for text in cells:
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    digest = hashlib.sha256(raw)
                    if digest.digest() not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(digest.digest())
                        made.append((digest.hexdigest(), len(raw), store(payload_of(raw))))
                if made:
                    yield _rows(made, _STORED)

    return scratch.keep(texts.select(F.col(f"`{text_col}`")).mapInArrow(run, "digest string, n_bytes long, media binary"), "payloads")


def describe(payloads: DataFrame) -> DataFrame:
    """Stored payloads (digest, n_bytes, media) -> per digest sizes, digests and feature of what is read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in rows_of(batch, 64):
                made = []
                for digest, n_bytes, media in zip(*columns, strict=True):
                    back = read_back(media)
                    if hashlib.sha256(back[:n_bytes]).hexdigest() != digest:
                        raise ValueError("a payload is not what its digest says")
                    made.append((digest, n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature(back)))
                yield _rows(made, _DESCRIBED)

    ddl = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = payloads.select("digest", "n_bytes", "media").mapInArrow(run, ddl)
    return rows.groupBy("digest").agg(*[F.first(c).alias(c) for c in rows.columns if c != "digest"])


# -- sequences -----------------------------------------------------------------------------------


class _Sequence(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.silent = 0
        self.figure: int | None = None

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text = []
        if said:
            self.out.append({"pos": len(self.out), "kind": "text", "text": said, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT_TAGS:
            self.silent += 1
        elif tag in MEDIA_TAGS and not self.silent:
            got = dict(attrs)
            if got.get("src"):
                self.flush()
                alt = " ".join((got.get("alt") or "").split()) or None
                self.out.append({"pos": len(self.out), "kind": tag, "text": None, "ref": got["src"], "caption": alt})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in BLOCK_TAGS or tag == "br":
            self.flush()
            if tag == "figure":
                self.figure = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if tag in SILENT_TAGS:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            mine = [x for x in self.out[self.figure or 0 :] if x["ref"]]
            if mine and said:
                for x in mine:
                    x["caption"] = said
            elif said:
                self.text.append(said)
                self.flush()
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if not self.silent:
            (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """Text blocks and media references of a page in order."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption:
        parser.handle_endtag("figcaption")
    parser.flush()
    return parser.out


SEQUENCE = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and ``sequence``: the ordered structs of each page."""
    item = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
    kind = pages.schema[id_col].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(id_col, to_arrow_type(kind)), ("sequence", pa.list_(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, pages_html in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.types[0]), pa.array([parse_sequence(h) for h in pages_html], schema.types[1])], schema=schema)

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, sequence {SEQUENCE}")


def references(sequences: DataFrame, id_col: str, prefix: str = "sha256:") -> DataFrame:
    """One row per media reference: id, pos, kind, ref, caption, digest (null if the reference names none)."""
    refs = sequences.select(id_col, F.explode("sequence").alias("x")).where("x.ref is not null").select(id_col, "x.pos", "x.kind", "x.ref", "x.caption")
    return refs.withColumn("digest", F.when(F.startswith("ref", F.lit(prefix)), F.substring("ref", len(prefix) + 1, 64)))


def payloads_of(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored payloads that are referred to, each once."""
    wanted = refs.where("digest is not null").select("digest").distinct()
    return wanted.join(stored.dropDuplicates(["digest"]), "digest")


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """All references, with the columns of ``known`` (one row a digest: payloads or descriptions), null where there is none."""
    return refs.join(known, "digest", "left")


#: A reference that no payload answers, in every page that op9 makes.
ABSENT = "thumbnail.png"


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of ``documents`` as a captioned media payload in a page of its own, between texts and beside an absent payload."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    scratch = Scratch(spark, "media")
    size, digest = F.octet_length("text").cast("string"), F.sha2(F.col("text").cast("binary"), 256)
    page = F.concat(F.lit('<article><h1>A text</h1><figure><img src="sha256:'), digest, F.lit('"><figcaption>Text of '), size, F.lit(f' bytes</figcaption></figure><p>Its <img src="{ABSENT}" alt="small picture"> is not kept.</p></article>'))
    sequences = interleave(docs.select("doc_id", page.alias("html")), "doc_id")
    refs = scratch.keep(references(sequences, "doc_id"), "references")
    stored = store_texts(docs, scratch)
    known = scratch.keep(describe(stored), "descriptions")
    scratch.drop(stored)
    found = resolve(refs, known).where(F.col("ref") != ABSENT)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
