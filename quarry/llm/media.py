"""Media columns: interleaved documents whose payloads are resolved by digest.

A page's HTML is parsed into an ordered sequence of text and media-reference structs; a
reference carries the digest its src names and the caption beside it, so captions stay
aligned with what they describe. Payloads live in a content-addressed store (digest ->
8-bit grey PNG, 64 samples a row) that is written to the shared folder and read back.
What is known of a payload is computed once per digest, where the payload is, and only
these short rows are joined to the references: payloads never travel by reference, and
thousands of references to one digest cost thousands of short rows.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, pick, scratch, small_batches, table, utf8

#: Samples in a PNG row; a payload is filled with zero bytes to whole rows, one at least.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_SCHEME = "media:sha256:"
SEGMENTS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, intact boolean"


def padded(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of WIDTH."""
    return data + bytes(-len(data) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An 8-bit grey PNG of WIDTH columns whose samples are the payload's bytes."""
    rows = len(payload) // WIDTH
    raw = bytearray(rows * (WIDTH + 1))  # a filter byte 0 leads each row
    for column in range(WIDTH):
        raw[column + 1 :: WIDTH + 1] = payload[column::WIDTH]
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(bytes(raw), level)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of a PNG as `encode_png` writes them; ValueError for anything else."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width, rows = 8, [], 0, 0
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width, rows, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey PNG")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    raw = zlib.decompress(b"".join(packed))
    if len(raw) != rows * (width + 1) or any(raw[:: width + 1]):
        raise ValueError("rows are filtered or missing")
    out = bytearray(rows * width)
    for column in range(width):
        out[column::width] = raw[column + 1 :: width + 1]
    return bytes(out)


class _Sequence(HTMLParser):
    """Ordered text and media structs of a page."""

    SILENT = ("script", "style", "template", "head", "noscript")
    BREAKS = ("p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "figure", "nav", "pre", "blockquote")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.silent = self.pre = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = "".join(self.words)
        text = text if self.pre else " ".join(text.split())
        if text:
            self.out.append({"position": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        got = dict(attrs)
        if tag in self.SILENT:
            self.silent += 1
        elif tag in ("img", "audio", "video", "source", "embed") and got.get("src"):
            self.flush()
            digest = got["src"].removeprefix(MEDIA_SCHEME) if got["src"].startswith(MEDIA_SCHEME) else hashlib.sha256(got["src"].encode("utf-8", "surrogatepass")).hexdigest()
            self.out.append({"position": len(self.out), "kind": "media", "text": None, "digest": digest, "caption": got.get("alt") or None})
            if self.figure is not None:
                self.figure.append(len(self.out) - 1)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in self.BREAKS:
            self.flush()
            self.pre += tag == "pre"
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            said = " ".join("".join(self.caption).split())
            for k in self.figure or []:
                self.out[k]["caption"] = said or self.out[k]["caption"]
            self.caption = None
        elif tag in self.BREAKS:
            self.flush()
            self.pre = max(0, self.pre - (tag == "pre"))
            if tag == "figure":
                self.figure = None

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.silent:
            self.words.append(data)


def parse_page(page: str | None) -> list[dict]:
    """The page's sequence; a null or empty page has none, broken markup yields what it can."""
    parser = _Sequence()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.out


SEGMENT = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))


def sequences(pages: DataFrame, key: str = "page_id", markup: str = "html", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also, segments): each page's ordered structs. One row per input row, null keys kept; `also` are columns of numbers."""
    names = [key, *also]
    narrow = pick(pages, **dict.fromkeys(names, "long"), **{markup: "string"})

    def parse(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([parse_page(x) for x in batch.column(len(names)).to_pylist()], type=SEGMENT)
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names)], found], names=[*names, "segments"])

    small_batches(pages.sparkSession)
    return map_arrow(narrow, parse, "".join(f"{n} long, " for n in names) + f"segments {SEGMENTS}")


def media_features(payload: bytes, media: bytes) -> tuple:
    """What is kept of a payload: sizes, digests, and its samples' mean, share of zeros and size once packed."""
    low, mean = payload.count(0), sum(payload) / len(payload)
    said = f"png8 64x{len(payload) // WIDTH} mean={mean:.3f} zero={low / len(payload):.4f} ratio={len(media) / len(payload):.4f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), said


def store_payloads(docs: DataFrame) -> DataFrame:
    """(digest, media) for every text and for the last row of its samples, written to the shared folder and reread."""

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        whole = [padded(x) for x in utf8(batch.column(0))]
        data = [*whole, *{x[-WIDTH:] for x in whole}]
        return pa.RecordBatch.from_pydict({"digest": [hashlib.sha256(x).hexdigest() for x in data], "media": [encode_png(x) for x in data]})

    small_batches(docs.sparkSession)
    return materialize(map_arrow(pick(docs, text="string"), pack, "digest string, media binary"), "media", "none")


def store_features(store: DataFrame) -> DataFrame:
    """One row per digest: features of the stored media, decoded; intact if they match their digest."""

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = decode_png(media)
            got = media_features(payload, media)
            rows.append((digest, *got, got[1] == digest))
        names = ["digest", *(x.split()[0] for x in FEATURES.split(", "))]
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    read_back = map_arrow(store, read, f"digest string, {FEATURES}")
    return read_back.dropDuplicates(["digest"])


def _figure(data: bytes, caption: str) -> str:
    return f'<figure><img src="{MEDIA_SCHEME}{hashlib.sha256(data).hexdigest()}"><figcaption>{caption}</figcaption></figure>'


def media_page(text: str | None) -> str:
    """A text as a page: its paragraphs, after the first a figure of its whole payload, at the end one of the payload's last row."""
    said = (text or "").encode("utf-8", "surrogatepass")
    payload = padded(said)
    first, _, rest = (text or "").partition("\n\n")
    paragraphs = "".join(f"<p>{html.escape(x)}</p>" for x in rest.split("\n\n") if x)
    return f"<article><p>{html.escape(first)}</p>{_figure(payload, f'all {len(said)} bytes')}{paragraphs}{_figure(payload[-WIDTH:], f'the last of {len(payload) // WIDTH} rows')}</article>"


def as_pages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, html) of every document."""

    def page(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in utf8(batch.column(1))], pa.int64()), pa.array([media_page(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "n_bytes", "html"])

    small_batches(docs.sparkSession)
    return map_arrow(pick(docs, doc_id="long", text="string"), page, "doc_id long, n_bytes long, html string")


def resolve(segments: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """A row per media reference in order: key, position, caption, digest and the payload's features (null if unknown)."""
    refs = segments.select(key, F.inline("segments")).filter("kind = 'media'").select(key, "position", "caption", "digest")
    return refs.join(features, "digest", "left")


def aligned(docs: DataFrame) -> DataFrame:
    """A row per document: its payload's and its payload's last row's features, with their places and captions in the sequence.

    Each document becomes a page, the page is parsed into its sequence of texts and
    references, and the references' digests are joined to what the store reads back. Null
    and empty texts give a payload of 64 zero bytes; very long texts are one payload each;
    equal texts share a digest, and so all values; rows that repeat are a row each; a null
    doc_id stays; other columns are ignored; an empty table gives no rows.
    """
    # written first: with an exchange on both sides, the join can split a digest that many documents share
    features = materialize(store_features(store_payloads(docs)), "features")
    found = sequences(as_pages(docs), "doc_id", "html", ("n_bytes",))
    refs = F.filter("segments", lambda s: s["kind"] == "media")
    columns = found.select("doc_id", "n_bytes", F.size("segments").alias("n_segments"), refs.alias("refs"))
    first, last = F.get("refs", F.lit(0)), F.get("refs", F.size("refs") - 1)
    short = columns.select("doc_id", "n_bytes", "n_segments", first["digest"].alias("digest"), first["position"].alias("position"), first["caption"].alias("caption"), last["digest"].alias("tail_digest"), last["position"].alias("tail_position"), last["caption"].alias("tail_caption"))
    tails = features.select(F.col("digest").alias("tail_digest"), F.col("payload_sha256").alias("tail_sha256"), F.col("tail_crc32").alias("row_crc32"), F.col("intact").alias("tail_intact"))
    rows = short.join(features, "digest", "left").join(tails, "tail_digest", "left")
    # the last row is stored by itself too, and both must say the same
    whole = F.col("intact") & F.col("tail_intact") & (F.col("tail_crc32") == F.col("row_crc32"))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments", "position", "caption", "tail_position", "tail_caption", "tail_sha256", whole.alias("intact"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """See `aligned`."""
    with scratch() as keep:
        return keep(materialize(aligned(table(spark, sf_dir, "documents")), "aligned"))
