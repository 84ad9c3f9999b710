"""Token-id shards: independent zstandard frames, a trailing seek table, a checksum per frame.

A shard is a sequence of zstandard frames followed by one skippable frame that holds the seek
table (the seekable layout of public zstandard tooling): per frame its compressed size, its
decompressed size and the low 32 bits of XXH64 of the decompressed bytes, then the number of
frames, a descriptor byte and the closing magic number. Frame 0 is the directory (the doc_ids as
little-endian signed 64-bit integers, and a null mark byte for each); frame i > 0 holds the ids of document i - 1 as
little-endian unsigned 32-bit integers. A reader fetches the last bytes, then only the frames of
the documents it wants, and checks their sums.

The number of shards follows the input (``SHARD_BYTES`` of text and ``SHARD_ROWS`` documents at most on
average), so what a task and the driver hold doesn't depend on the number of shuffle partitions.

Null and empty texts yield the end id alone; a null doc_id is kept and sorts first; repeated rows are
separate documents, ordered by doc_id and then by a hash of the text, by which rows of one doc_id, or of
none, are dealt over several shards too. A long text is one frame. An empty table has no shards and
no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SKIPPABLE, SEEKABLE, WITH_SUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
END_ID = 1
SHARDS = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
LEVEL = 1
SHARD_BYTES, SHARD_ROWS = 64 << 20, 200_000
#: Bytes of text that are encoded together.
CHUNK = 2 << 20
#: A word's ids are remembered until so many words are; then all but the first are dropped.
MEMO_WORDS, KEPT_WORDS = 800_000, 300_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Places(dict):
    """Numbers words in the order in which they are first asked for, and notes the new ones."""

    def __init__(self, new: list[bytes]):
        super().__init__()
        self.new = new

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at


class Encoder:
    """Whole-text encoding with the tokenizers library, word by word.

    The vocabulary's pre-tokenizer never joins characters across white space, its normalizer maps
    each character alone (NFC composes nothing across a space) and its special strings hold no
    space, so a text's ids are the ids of its words (parts between ASCII white space) in order.
    The library encodes each word once as long as it is remembered, many in one call: plain words
    are joined by spaces and told apart by the vocabulary's end-of-word pieces, of which a word of
    letters has one and a word with punctuation behind it two; all others are joined by a special
    string, whose id parts them.
    """

    LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
    PLAIN = re.compile(f"[{LETTERS}]+([.,!*$#&%|:;?]+)?")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.bar, self.bar_id = next((p, i) for p, i in vocabulary.items() if p == "<|startoftext|>")
        self.new: list[bytes] = []
        self.places, self.ids = Places(self.new), []

    def forget(self) -> None:
        """Drop all but the words seen first, which are the frequent ones."""
        kept = Places(self.new)
        kept.update(itertools.islice(self.places.items(), KEPT_WORDS))
        self.places, self.ids = kept, self.ids[:KEPT_WORDS]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self) -> None:
        """Encode the words that were asked for and aren't known."""
        words = [w.decode("utf-8", "surrogatepass") for w in self.new]
        got: list = [b""] * len(words)
        groups: tuple[list, list, list] = ([], [], [])
        for k, w in enumerate(words):
            m = self.PLAIN.fullmatch(w)
            groups[0 if m is None else 1 if m[1] is None else 2].append(k)
        for pieces, group in enumerate(groups):
            if not group:
                continue
            if pieces:
                ids = self._ids(" ".join([words[k] for k in group]))
                cut = np.flatnonzero(self.ends[ids])[pieces - 1 :: pieces] + 1
                stop, skip = cut * 4, 0
            else:
                if any(self.bar in words[k] for k in group):
                    for k in group:
                        got[k] = self._ids(words[k]).tobytes()
                    continue
                ids = self._ids(self.bar.join([words[k] for k in group]))
                stop, skip = np.append(np.flatnonzero(ids == self.bar_id), len(ids)) * 4, 4
            if len(stop) != len(group):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            data, at = ids.tobytes(), 0
            for k, to in zip(group, stop.tolist(), strict=True):
                got[k] = data[at:to]
                at = to + skip
        self.ids += got
        self.new.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > MEMO_WORDS:
            self.forget()
        place = self.places.__getitem__
        at = [list(map(place, t.split())) for t in texts]
        self.learn()
        ids = self.ids.__getitem__
        return [b"".join(map(ids, a)) for a in at]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class ShardWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.table, self.z = out, [], zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def frame(self, data: bytes) -> None:
        packed = self.z.compress(data)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(data), checksum(data)))

    def close(self) -> None:
        body = b"".join(self.table) + struct.pack("<IBI", len(self.table), WITH_SUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class ShardReader:
    """Random access to the frames of an open seekable shard."""

    def __init__(self, file, size: int):
        import zstandard

        self.file, self.z = file, zstandard.ZstdDecompressor()
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or flags != WITH_SUMS:
            raise ValueError("not a seekable shard")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, i: int) -> bytes:
        packed, plain, want = (int(x) for x in self.table[i])
        self.file.seek(int(self.at[i]))
        data = self.z.decompress(self.file.read(packed), max_output_size=plain)
        if len(data) != plain or checksum(data) != want:
            raise ValueError(f"frame {i} is damaged")
        return data

    def doc_ids(self) -> list[int | None]:
        d = self.frame(0)
        n = len(d) // 9
        ids, null = np.frombuffer(d, "<i8", n), np.frombuffer(d, "u1", n, 8 * n)
        return [None if x else int(i) for i, x in zip(ids, null, strict=True)]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the shard's k-th document."""
        return np.frombuffer(self.frame(k + 1), dtype="<u4")


def open_shard(uri: str) -> ShardReader:
    fs, path = shared.filesystem(uri)
    return ShardReader(fs.open_input_file(path), fs.get_file_info(path).size)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write one shard per partition, in ascending doc_id order.

    Returns (shard, uri, n_docs, n_tokens) per shard. Frames of a task wait in its memory only as
    one compressed document each. A task that is run again writes another file; the list names
    the file of the attempt that was committed.
    """
    spark = docs.sparkSession
    shared.ship(spark)
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def encoded(batch):
        enc, some, size = encoder(tokenizer), [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            some.append((i, t or b""))
            size += len(some[-1][1])
            if size > CHUNK:
                yield from zip([x[0] for x in some], enc.encode([x[1] for x in some]), strict=True)
                some, size = [], 0
        yield from zip([x[0] for x in some], enc.encode([x[1] for x in some]), strict=True)

    def work(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        shard = task.partitionId()
        fs, base = shared.filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{shard:06d}-{task.taskAttemptId()}.zst"
        ids, null, total = [], [], 0
        # The directory comes first, so the frames of documents are spooled beside it.
        with fs.open_output_stream(f"{base}/{name}.part", compression=None) as spool:
            out = ShardWriter(spool)
            for batch in batches:
                for i, data in encoded(batch):
                    data += end
                    out.frame(data)
                    total += len(data) // 4
                    ids.append(i or 0)
                    null.append(i is None)
        if not ids:
            fs.delete_file(f"{base}/{name}.part")
            return
        with fs.open_output_stream(f"{base}/{name}", compression=None) as final, fs.open_input_stream(f"{base}/{name}.part", compression=None) as spool:
            head = ShardWriter(final)
            head.frame(np.asarray(ids, "<i8").tobytes() + np.asarray(null, "u1").tobytes())
            while chunk := spool.read(1 << 20):
                final.write(chunk)
            head.table += out.table
            head.close()
        fs.delete_file(f"{base}/{name}.part")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": f"{folder}/{name}", "n_docs": len(ids), "n_tokens": total}], SHARDS)

    count, size = shared.sized(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES), -(-count // SHARD_ROWS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    made = rows.select("doc_id", "text").mapInArrow(work, "shard int, uri string, n_docs long, n_tokens long")
    return shared.stored(made, "shards", folder)


def read(shards: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start, n_tokens, ids_crc32; all from the files.

    ``start`` needs the token counts of the shards before; there is one row per shard, so the
    running sum over them is bounded by the number of partitions written.
    """
    spark = shards.sparkSession
    shared.ship(spark)
    listed = shards.orderBy("shard").collect()
    starts = list(itertools.accumulate((r.n_tokens for r in listed), initial=0))
    plan = [(r.uri, s) for r, s in zip(listed, starts, strict=False)]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not plan:
        return spark.createDataFrame([], schema)

    def work(batches):
        for pdf in batches:
            for uri, start in zip(pdf.uri, pdf.start, strict=True):
                shard, rows = open_shard(uri), []
                for k, doc in enumerate(shard.doc_ids()):
                    data = shard.frame(k + 1)
                    rows.append((doc, start, len(data) // 4, zlib.crc32(data)))
                    start += len(data) // 4
                    if len(rows) >= 20_000:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    def frame(rows):
        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"], dtype="object")
        return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    tasks = spark.createDataFrame(plan, "uri string, start long").repartition(min(len(plan), 4096))
    return tasks.mapInPandas(work, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read(write(docs, shared.shared_dir(spark)))
