"""Media columns as interleaved sequences of text and media references.

``sequences`` parses HTML into an ordered array of items: runs of text and references to media by
digest, with the caption of the figure they stand in. ``Packs`` keep the media themselves: a task
appends each medium to its own pack file in the shared folder and a catalogue names pack, offset and
length by digest. ``resolve`` joins references to the catalogue by digest, reads the bytes back by
range, pack by pack, once for each digest, and joins the results to every reference; positions and
captions stay with their reference.

``as_medium`` stores bytes losslessly as 8-bit grey samples of a PNG image 192 samples wide, padded
with byte 32; the length before padding is kept in the image's text chunk.

Null and empty html has no items; references without a digest of ours, or to media that the catalogue lacks,
keep null media. Equal media are stored once in the catalogue. Null text is stored as empty text:
one row of spaces. Repeated rows give repeated results. Long texts are stored whole, as images of many
rows. Empty tables give no rows. Columns items, pos, caption and digest, and those of the media's values, are
replaced; the query reads doc_id and text only.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

WIDTH, PAD = 192, b"\x20"
SCHEME = "media:"
LEVEL = 6
#: The start of every PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
ITEM = "struct<pos:int,kind:string,text:string,src:string,digest:string,caption:string>"
#: Elements whose content isn't text of the document, and those that end a run of text.
SILENT = {"script", "style", "noscript", "template", "head", "title"}
IN_HEAD = {"title", "meta", "link", "script", "style", "base", "noscript", "template", "head"}
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "section", "article", "header", "footer", "nav", "aside", "main", "figure", "figcaption", "blockquote", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "body", "html"}
MEDIA = {"img", "video", "audio", "source", "embed"}


class _Items(HTMLParser):
    """Collects items. Elements whose content isn't text are silent until they end; a head ends at its end tag or, as
    HTML allows it to be left out, at the first element that a head can't hold. Media in silent elements are left out too.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.run, self.silent, self.figures, self.caption = [], [], [], [], None

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if self.silent and self.silent[0] == "head" and tag not in IN_HEAD:
            self.silent.clear()
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            a = dict(attrs)
            if a.get("src"):
                self.flush()
                digest = a["src"][len(SCHEME) :] if a["src"].startswith(SCHEME) else None
                item = {"kind": "media", "text": None, "src": a["src"], "digest": digest, "caption": a.get("alt") or a.get("title") or None}
                self.items.append(item)
                if self.figures:
                    self.figures[-1].append(item)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in SILENT and tag in self.silent:
            del self.silent[self.silent.index(tag) :]

    def handle_endtag(self, tag):
        if tag in self.silent:
            # what is still open inside it ends with it
            del self.silent[self.silent.index(tag) :]
            return
        if self.silent:
            return
        if tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.caption = None
            for item in self.figures[-1] if self.figures and text else ():
                item["caption"] = text
        elif tag == "figure" and self.figures:
            self.caption = None
            self.figures.pop()
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data):
        if self.silent:
            return
        (self.run if self.caption is None else self.caption).append(data)


def parse(html: str | None) -> list[dict]:
    """Ordered items of a page; a caption goes to the media of its figure, not into the text."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": k} | x for k, x in enumerate(p.items)]


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with html replaced by items, in document order."""
    pages = pages.drop("items")
    shared.ship(pages.sparkSession)
    at, keep = pages.columns.index(html), [k for k, c in enumerate(pages.columns) if c != html]
    item = pa.struct([("pos", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "src", "digest", "caption"))])

    def work(batches):
        for batch in batches:
            items = pa.array([parse(t) for t in batch.column(at).to_pylist()], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), items], names=[*(batch.schema.names[k] for k in keep), "items"])

    schema = ", ".join([f"`{pages.columns[k]}` {pages.dtypes[k][1]}" for k in keep] + [f"items array<{ITEM}>"])
    return pages.mapInArrow(work, schema)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def as_medium(data: bytes) -> bytes:
    """A PNG image of the bytes."""
    rows = max(1, -(-len(data) // WIDTH))
    samples = np.full((rows, WIDTH + 1), PAD[0], np.uint8)
    samples[:, 0] = 0
    flat = np.full(rows * WIDTH, PAD[0], np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    samples[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_medium(png: bytes) -> tuple[bytes, int]:
    """(payload, its length before padding) of an image made by ``as_medium``; every chunk's sum is checked."""
    if not png.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, head, packed, n = len(SIGNATURE), None, [], None
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", png, at + 8 + size)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"tEXt" and data.startswith(b"bytes\0"):
            n = int(data[6:])
        at += 12 + size
    if head is None or head[2:] != (8, 0, 0, 0, 0) or n is None:
        raise ValueError("not 8-bit grey samples of ours")
    samples = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(head[1], head[0] + 1)
    if samples[:, 0].any():
        raise ValueError("filtered rows")
    return samples[:, 1:].tobytes(), n


def feature(payload: bytes) -> str:
    """Whole-number features of the samples: size, sum, extremes, squares and changes along rows."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH).astype(np.int64)
    hist = np.bincount(x.ravel() >> 5, minlength=8)
    return f"w={WIDTH};h={len(x)};sum={x.sum()};min={x.min()};max={x.max()};sq={(x * x).sum()};dx={np.abs(np.diff(x, axis=1)).sum()};hist={','.join(map(str, hist))}"


PACKED = "doc_id long, html string, digest string, uri string, at long, size long"


def pack(docs: DataFrame, folder: str) -> DataFrame:
    """Store each text of ``docs`` as a medium and make a page that shows it; the rows are written to the shared folder.

    A task that runs again writes another pack; rows name the packs of the attempt that was committed.
    A task stores equal media once as long as it remembers them; it forgets at 200,000 digests, which
    stores more and changes no result.
    """
    shared.ship(docs.sparkSession)

    def work(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, base = shared.filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"pack-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
        at, seen = 0, {}
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            for batch in batches:
                rows = []
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    png = as_medium(t or b"")
                    digest = hashlib.sha256(png).hexdigest()
                    if digest in seen:
                        place = seen[digest]
                    else:
                        place = seen[digest] = at
                        out.write(png)
                        at += len(png)
                    if len(seen) > 200_000:
                        seen.clear()
                    rows.append((i, f'<h1>Text</h1><figure><img src="{SCHEME}{digest}" alt="samples"><figcaption>{len(t or b"")} bytes</figcaption></figure>', digest, f"{folder}/{name}", place, len(png)))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names=["doc_id", "html", "digest", "uri", "at", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return shared.stored(rows.mapInArrow(work, PACKED), "rows", folder)


def catalogue(packed: DataFrame) -> DataFrame:
    """One place (uri, at, size) for each digest."""
    return packed.groupBy("digest").agg(F.min(F.struct("uri", "at", "size")).alias("place")).select("digest", "place.*")


RESULT = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def examined(places: DataFrame) -> DataFrame:
    """What the media at ``places`` hold, read from the packs and decoded; one row for each digest."""
    shared.ship(places.sparkSession)
    n = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches):
        uri, file = None, None
        for batch in batches:
            rows = []
            for d, u, at, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if u != uri:
                    if file is not None:
                        file.close()
                    fs, path = shared.filesystem(u)
                    uri, file = u, fs.open_input_file(path)
                file.seek(at)
                png = file.read(size)
                if hashlib.sha256(png).hexdigest() != d:
                    raise ValueError(f"the medium {d} is damaged")
                payload, n_bytes = from_medium(png)
                rows.append((d, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), d, feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], names=names)
        if file is not None:
            file.close()

    # Ranges of (uri, at), so that a task reads few packs, each forwards, and no pack is one task's.
    return places.repartitionByRange(n, "uri", "at").sortWithinPartitions("uri", "at").mapInArrow(work, RESULT)


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each media item of ``seqs`` (items): its other columns, pos, caption, digest and the columns of ``media`` by digest.

    Columns of ``seqs`` that have one of these names, in any case of letters, are replaced.
    """
    made = {"items", "pos", "caption", "digest", *map(str.lower, media.columns)}
    own = [c for c in seqs.columns if c.lower() not in made]
    # the page's columns stay in a struct until items are taken apart, so that no name of theirs is in the way
    each = seqs.select(F.struct(F.lit(0).alias("items"), *[F.col(f"`{c}`") for c in own]).alias("page"), F.explode("items").alias("item")).filter("item.kind = 'media'")
    refs = each.select(*[F.col(f"page.`{c}`") for c in own], *[F.col(f"item.{c}") for c in ("pos", "caption", "digest")])
    return refs.join(media, "digest", "left")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack(docs, f"{shared.shared_dir(spark)}/packs")
    media = examined(catalogue(packed))
    found = resolve(sequences(packed.select("doc_id", "html")), media)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption")
