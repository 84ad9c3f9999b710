"""SentencePiece encoding and decoding over a relational lattice.

Spaces are written as U+2581 and one is put before the text. No piece of the model goes on after
a space or holds a line feed (this is checked), so a text falls into units that are solved one by
one: spaces with the word behind them, and line feeds. Characters without a piece become their
UTF-8 bytes' pieces; decoding gives back the text.

The lattice is relational: the substrings of a unit, up to the longest piece, are exploded and
equi-joined with the piece table (a fixed 32,000 rows, broadcast), edges are grouped by unit, and a
higher-order aggregate folds them. There are two folds. "unigram" is Viterbi: the path with the
largest sum of scores, from left to right and back (ties: the longer last piece). "bpe" takes the
edge of the highest score between two neighbours that stand, again and again (ties: the first).
The model file names its type, which picks the fold; the scores of a BPE model are merge ranks, and
a Viterbi path over their sum isn't what that model encodes.

The results are a dictionary of the ``WORDS`` or fewer most frequent units of the corpus. Documents
are encoded against it in Arrow batches; a unit that isn't in it runs through the same fold in
place (``Pieces.solve``). To join every token with every distinct unit instead would shuffle
several times the corpus. The dictionary decides where a unit is solved, never its ids.

Null and empty texts have no ids; a long text is encoded whole, and an empty table gives no rows. U+2581 in a text can't be told from a space when decoded; such
documents have ``exact`` false. Repeated rows give repeated results.
A column ids is replaced where it exists.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SPACE = "▁"
WORDS = 131_072
#: Longer units are solved in place.
LONGEST = 48
UNKNOWN = -4e9
UNIT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
#: A worker's memo starts anew at so many units; its counts go out at so many.
MEMO, COUNTED = 400_000, 150_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: What stands for a pair that is no piece.
NONE = (-1, float("-inf"))


def model_type(path: str) -> str:
    """'bpe' or 'unigram', from the model file."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    kind = {1: "unigram", 2: "bpe"}.get(m.trainer_spec.model_type)
    if kind is None or m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.add_dummy_prefix:
        raise ValueError("a model of type bpe or unigram that keeps the text as it is and puts a space first is needed")
    return kind


class Pieces:
    """The piece table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        self.kind = model_type(path)
        self.names = [p.id_to_piece(i) for i in range(n)]
        kinds = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)]
        self.byte = {i: int(self.names[i][1:-1], 16) for i in range(n) if p.is_byte(i)}
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.table = {self.names[i]: (i, float(p.get_score(i))) for i in range(n) if not kinds[i] and i not in self.byte}
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte pieces")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", x) for x in self.table):
            raise ValueError("a piece goes on after a space or holds a line feed")
        self.longest = max(map(len, self.table))
        self.prefixes = {x[:k] for x in self.table for k in range(1, len(x) + 1)}
        self.bytes = [bytes([self.byte[i]]) if i in self.byte else b"" if kinds[i] else x.replace(SPACE, " ").encode() for i, x in enumerate(self.names)]

    def spelled(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]

    def best_path(self, unit: str) -> list[int]:
        """Ids of the best path through a unit's lattice."""
        n, table, prefixes = len(unit), self.table, self.prefixes
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        for s in range(n):
            low = best[s]
            for e in range(s + 1, min(n, s + self.longest) + 1):
                x = unit[s:e]
                if x not in prefixes:
                    break
                if x in table:
                    i, score = table[x]
                    if best[e] is None or low + score > best[e]:
                        best[e], back[e] = low + score, (s, i)
            if unit[s] not in table and (best[s + 1] is None or low + UNKNOWN > best[s + 1]):
                best[s + 1], back[s + 1] = low + UNKNOWN, (s, -1)
        out, e = [], n
        while e:
            s, i = back[e]
            out += self.spelled(unit[s])[::-1] if i < 0 else [i]
            e = s
        return out[::-1]

    def merged(self, unit: str) -> list[int]:
        """Ids of a unit by merging the neighbours that make the piece of the highest score, the first of equals."""
        table, parts = self.table, list(unit)
        if len(parts) > 64:
            parts = self._merged_long(parts)
        else:
            scores = [table.get(x + y, NONE)[1] for x, y in zip(parts, parts[1:], strict=False)]
            while scores:
                best = max(scores)
                if best == NONE[1]:
                    break
                k = scores.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                del scores[k]
                if k < len(scores):
                    scores[k] = table.get(parts[k] + parts[k + 1], NONE)[1]
                if k:
                    scores[k - 1] = table.get(parts[k - 1] + parts[k], NONE)[1]
        out = []
        for x in parts:
            out += [table[x][0]] if x in table else self.spelled(x)
        return out

    def _merged_long(self, parts: list) -> list:
        """The same with a heap and links, in time n log n."""
        table, n = self.table, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k):
            if k >= 0 and parts[k] is not None and after[k] < n:
                x = parts[k] + parts[after[k]]
                if x in table:
                    heapq.heappush(heap, (-table[x][1], k, x))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, x = heapq.heappop(heap)
            if parts[k] is None or after[k] >= n or parts[k] + parts[after[k]] != x:
                continue
            gone = after[k]
            parts[k], parts[gone], after[k] = x, None, after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            offer(before[k])
        return [x for x in parts if x is not None]

    def solve(self, unit: str) -> list[int]:
        return self.merged(unit) if self.kind == "bpe" else self.best_path(unit)

    def decode(self, ids) -> bytes:
        """The UTF-8 text of a document's ids: the space that encoding put first is taken off."""
        text = b"".join(map(self.bytes.__getitem__, ids))
        return text[1:] if text[:1] == b" " else text


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def units(text: str) -> list[str]:
    """The units of a text in order."""
    if not text:
        return []
    out = []
    for k, line in enumerate(text.split("\n")):
        if k:
            out.append("\n")
        words = line.split(" ")
        if "" in words or SPACE in line:
            out += UNIT.findall((SPACE if k == 0 else "") + line.replace(" ", SPACE))
            continue
        if k == 0:
            out.append(SPACE + words[0])
        else:
            out.append(words[0])
        out += [SPACE + w for w in words[1:]]
    return out


def frequent(docs: DataFrame, most: int = WORDS) -> DataFrame:
    """(unit): at most ``most`` units, the most frequent ones of all texts, none of one use only.

    Workers count their batches; a unit that a worker saw once is left out, since missing the
    dictionary costs time and nothing else.
    """
    shared.ship(docs.sparkSession)

    def work(batches):
        _ENCODERS.clear()  # of an earlier corpus
        seen: Counter = Counter()

        def flush():
            kept = [(u, c) for u, c in seen.items() if c > 1 and len(u) <= LONGEST]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["unit", "uses"])

        for batch in batches:
            for part in shared.parts(batch):
                for t in part.column(0).to_pylist():
                    seen.update(units(t or ""))
                if len(seen) > COUNTED:
                    yield flush()
        yield flush()

    counts = shared.stored(docs.select(F.col("text").cast("string")).mapInArrow(shared.tidy(work), "unit string, uses long").groupBy("unit").agg(F.sum("uses").alias("uses")), "units")
    # The least number of uses by which no more than ``most`` units are left, from a table of powers.
    sizes = counts.groupBy(F.floor(F.log2("uses") * 8).cast("int").alias("octave")).count().orderBy(F.desc("octave")).collect()
    total, least = 0, None
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r.octave
    return counts.filter(F.floor(F.log2("uses") * 8) >= (least if least is not None else 10**6)).select("unit")


def edges(words: DataFrame, table: Pieces) -> DataFrame:
    """(unit, s, e, id, score): the pieces in each unit, from character s to e; a character without a piece is minus its code point."""
    listed = pa.table({"piece": list(table.table), "id": pa.array([x[0] for x in table.table.values()], pa.int32()), "score": [x[1] for x in table.table.values()]})
    known = F.broadcast(words.sparkSession.createDataFrame(listed))
    n = F.length("unit")
    starts = words.filter(n > 0).select("unit", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    spans = starts.select("unit", "s", F.explode(F.sequence(F.col("s"), F.least(n, F.col("s") + table.longest - 1))).alias("e"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("s"), F.col("e") - F.col("s") + 1))
    found = spans.join(known, "piece", "left").filter(F.col("id").isNotNull() | (F.col("s") == F.col("e")))
    return found.select("unit", "s", "e", F.coalesce("id", -F.ascii("piece")).alias("id"), F.coalesce("score", F.lit(UNKNOWN)).alias("score"))


def viterbi(found: DataFrame) -> DataFrame:
    """(unit, ids): the path of the largest sum of scores."""
    ends = found.groupBy("unit", "e").agg(F.collect_list(F.struct("s", "id", "score")).alias("into"))
    columns = ends.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("e", "into"))).alias("ends"))
    # Forward: at each end the best (score, start, id); position 0 is the start of the unit.
    node = lambda score, s, i: F.struct(score.alias("score"), s.alias("before"), i.alias("id"))
    first = F.array(node(F.lit(0.0), F.lit(0), F.lit(0)))
    step = lambda acc, x: F.concat(acc, F.array(F.array_max(F.transform(x.into, lambda g: node(F.get(acc, g.s - 1).score + g.score, F.lit(0) - g.s, g.id)))))
    solved = columns.select("unit", F.aggregate("ends", first, step).alias("best"))
    # Back: from the last position to 0, ids in front.
    begin = F.struct((F.size("best") - 1).alias("at"), F.array().cast("array<int>").alias("ids"))
    back = lambda acc, _: F.when(acc.at == 0, acc).otherwise(F.struct((F.lit(-1) - F.get("best", acc.at).before).alias("at"), F.concat(F.array(F.get("best", acc.at).id), acc.ids).alias("ids")))
    return solved.select("unit", F.aggregate("best", begin, back).ids.alias("ids"))


def merges(found: DataFrame) -> DataFrame:
    """(unit, ids): neighbours merge by the highest score. The state is the array of borders between parts."""
    key = lambda s, e: F.shiftleft(s.cast("long"), 32) + e
    entry = F.struct(key(F.col("s"), F.col("e")).alias("key"), F.struct("score", "id").alias("value"))
    grouped = found.groupBy("unit").agg(F.map_from_entries(F.collect_list(entry)).alias("pieces"))
    of = lambda s, e: F.try_element_at("pieces", key(s + 1, e))

    def step(borders, _):
        inner = F.sequence(F.lit(1), F.size(borders) - 2)
        best = F.array_max(F.transform(inner, lambda k: F.struct(of(F.get(borders, k - 1), F.get(borders, k + 1)).score.alias("score"), (-k).alias("at"))))
        fewer = F.when(best.score.isNull(), borders).otherwise(F.filter(borders, lambda x, k: k != -best.at))
        return F.when(F.size(borders) <= 2, borders).otherwise(fewer)

    n = F.length("unit")
    solved = grouped.select("unit", "pieces", F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(0), n), step).alias("borders"))
    ids = F.transform(F.sequence(F.lit(1), F.size("borders") - 1), lambda k: of(F.get("borders", k - 1), F.get("borders", k)).id)
    return solved.select("unit", ids.alias("ids"))


def lattice(words: DataFrame, model: str | None = None, kind: str | None = None) -> DataFrame:
    """(unit, ids) of each unit by the relational lattice and the fold of the model's type."""
    table = pieces(model or default_model())
    found = edges(words, table)
    return merges(found) if (kind or table.kind) == "bpe" else viterbi(found)


class Encoder:
    def __init__(self, model: str, folder: str | None):
        self.pieces, self.known = pieces(model), {}
        if folder:
            import pyarrow.parquet as pq
            from pyarrow import fs as pafs

            fs, path = shared.filesystem(folder)
            for f in fs.get_file_info(pafs.FileSelector(path)):
                if f.path.endswith(".parquet"):
                    with fs.open_input_file(f.path) as file:
                        t = pq.read_table(file)
                    for u, ids in zip(t.column("unit").to_pylist(), t.column("ids").to_pylist(), strict=True):
                        self.known[u] = self._packed(list(chain.from_iterable([i] if i >= 0 else self.pieces.spelled(chr(-i)) for i in ids)))
        self.memo = Memo(self)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, units(text or "")))


class Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__(encoder.known)
        self.encoder = encoder

    def __missing__(self, unit: str) -> bytes:
        if len(self) > MEMO:
            self.clear()
            self.update(self.encoder.known)
        ids = self[unit] = Encoder._packed(self.encoder.pieces.solve(unit))
        return ids


_ENCODERS: dict = {}


def encoder(model: str, folder: str) -> Encoder:
    if (model, folder) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[model, folder] = Encoder(model, folder)
    return _ENCODERS[model, folder]


def dictionary(docs: DataFrame, model: str, most: int = WORDS) -> str:
    """Folder of the corpus' frequent units with their ids."""
    base = shared.shared_dir(docs.sparkSession)
    shared.stored(lattice(frequent(docs, most), model), "dictionary", base)
    return f"{base}/dictionary"


def encoded(docs: DataFrame, model: str | None = None, most: int = WORDS) -> DataFrame:
    """``docs`` with text replaced by its ids (array of int)."""
    docs, model = docs.drop("ids"), model or default_model()
    folder = dictionary(docs.select("text"), model, most)
    at, keep = docs.columns.index("text"), [k for k, c in enumerate(docs.columns) if c != "text"]

    def work(batches):
        for batch in batches:
            enc = encoder(model, folder)
            for part in shared.parts(batch):
                data = [enc.encode(t) for t in part.column(at).to_pylist()]
                ends = np.cumsum([0, *(len(d) // 4 for d in data)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(data), "<i4")))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), ids], names=[*(part.schema.names[k] for k in keep), "ids"])

    schema = ", ".join([f"`{docs.columns[k]}` {docs.dtypes[k][1]}" for k in keep] + ["ids array<int>"])
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(shared.tidy(work), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number and sum of its ids, and what decoding them gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = default_model()
    folder = dictionary(docs.select("text"), model)

    def work(batches):
        for batch in batches:
            enc, rows = encoder(model, folder), []
            for part in shared.parts(batch):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = enc.encode(t)
                    text = enc.pieces.decode(np.frombuffer(ids, "<u4").tolist())
                    rows.append((i, len(ids) // 4, zlib.crc32(ids), hashlib.sha256(text).hexdigest(), text == shared.utf8(t)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names=["doc_id", "n_ids", "ids_crc32", "text_sha256", "exact"])

    return docs.mapInArrow(shared.tidy(work), "doc_id long, n_ids long, ids_crc32 long, text_sha256 string, exact boolean")
