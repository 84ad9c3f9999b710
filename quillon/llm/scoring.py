"""Language-model scoring by online logistic context mixing over the bits of a token code.

Tokens are a text's words, lower-cased in A-Z, then one end. The ``CODED`` most frequent words have
leaves of their own in a Huffman code; all other words are dealt by crc32 into buckets whose number
follows the number of distinct words, and each bucket is a leaf, as the end is. Every bit of every
token's code is predicted in turn:

* predictors: for five contexts (none; the last word; the last two; the last two function words;
  the word before the last) the counts of ones and zeros seen under hash(context, code node) in the
  training documents;
* mixing: the predictors' log odds are summed with weights picked by a gate (place in the code,
  and whether the two-word context was seen). Weights start from a fit and adapt online in each
  document: after 1, 2, 4, 8 and 16 tokens, then after every ``STEP`` (16) tokens, at every length;
* refinement: a table over (place in the code, mixed odds), which starts from the fit's counts and
  adapts with the weights in each document, corrects the mixed probability.

A word in a bucket has probability (c + 1) / (C + U + 1) there: c is its count in the training
documents, C and U are the bucket's tokens and distinct words; a word that training lacks counts
as one more type. So all tokens' probabilities sum to 1 at any point. ``score`` is the sum of log10
probabilities; the base score is the add-one unigram model's.

Training documents are those whose crc32(doc_id as text) mod 7 isn't 2. Weights are fitted on those
with remainder ``FIT``, against counts that leave them out; then their counts are added, so the
predictors hold all training documents. Each fit document is run through the scorer, and the mean of
the documents' last weights, weighted by bits, is the start of all; sums are of whole numbers, so
scores are the same however rows are partitioned or ordered.

The vocabulary is a distributed aggregate without a limit. Workers add predictor counts into hashed
tables and send the blocks that aren't empty; blocks are summed in sorted streams, in two levels where
there are many counting tasks (``LEVEL_TOKENS``). The number of slots follows the number of
training tokens up to ``MOST_BITS``, the size that a worker's memory holds: above about 8 million
training tokens contexts share slots more and more, without a check. A dictionary of the ``KNOWN`` or
fewer most frequent words gives counts on the spot; the words it lacks are joined with the whole
vocabulary.

Null and empty text is the end alone. A null doc_id counts as training, under the crc of the empty
text. Repeated rows are scored each, alike, and count as often as they occur. Long texts are scored
whole, in lanes beside others. An empty table gives no rows. Other columns, whatever their names,
are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FOLDS, HELD_OUT, FIT = 7, 2, 3
CODED, KNOWN = 8192, 262_144
LEAST_BITS, MOST_BITS, BLOCK_BITS = 14, 21, 14
INPUTS, PLACES, FUNCTION_WORDS = 5, 16, 256
GATES = PLACES * 2
#: Places of a code whose states of one context share a group of slots.
LEVELS = 3
#: Tokens between changes of a document's weights, after the first ones; documents that are scored
#: side by side; tokens that are numbered together, and counted together; words remembered.
STEP, LANES, POOL_TOKENS, COUNT_TOKENS, MEMO = 16, 160, 200_000, 16_000, 300_000
CLIP, BUCKETS = 8.0, 33
#: Predictors' log odds are kept as whole 127ths of CLIP.
SCALE = 127 / CLIP
FLUSH = 500_000
ONLINE_RATE, ONLINE_INERTIA = 0.4, 30.0
#: Bits that the fitted refinement counts for in each text, against the text's own.
REFINE_INERTIA = 60.0
FIT_ROUNDS = 1
#: Weights and logarithms are summed as whole numbers of 1 / UNIT.
UNIT = 1 << 24
#: How many powers of two the buckets stay below the root of the distinct words.
LESS = 4
#: Training tokens for each first-level sum of predictor blocks.
LEVEL_TOKENS = 1 << 31


def remainder(doc_id) -> int:
    return zlib.crc32(b"" if doc_id is None else b"%d" % doc_id) % FOLDS


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the document's fold."""
    i = F.col("doc_id").cast("long")
    fold = F.pmod(F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    return docs.select(i.alias("doc_id"), F.col("text").cast("binary").alias("text"), fold.alias("fold"))


def vocabulary(docs: DataFrame, base: str) -> DataFrame:
    """(word, c) over the training documents, without the end."""

    def work(batches):
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(tokens(t))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    texts = _rows(docs).filter(F.col("fold") != HELD_OUT).select("text")
    counted = texts.mapInArrow(work, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    return shared.stored(counted, "vocabulary", base)


def _octave():
    return F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")


def least_octave(words: DataFrame, most: int) -> int:
    """A bound, from a histogram of powers, that at most ``most`` words of (word, c) reach."""
    total, least = 0, 10**6
    for r in words.groupBy(_octave().alias("octave")).count().orderBy(F.desc("octave")).collect():
        total += r["count"]
        if total > most:
            break
        least = r.octave
    return least


def huffman(weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each leaf's code, code nodes, code bits), flat."""
    heap = [(w, i, None) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n, parent = len(weights), {}
    while len(heap) > 1:
        (x, i, _), (y, j, _) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j] = (n, 0), (n, 1)
        heapq.heappush(heap, (x + y, n, None))
        n += 1
    start, nodes, bits = [0], [], []
    for leaf in range(len(weights)):
        path, at = [], leaf
        while at in parent:
            at, bit = parent[at]
            path.append((at - len(weights), bit))
        nodes += [x for x, _ in reversed(path)]
        bits += [y for _, y in reversed(path)]
        start.append(len(nodes))
    return np.array(start), np.array(nodes, np.int64), np.array(bits, np.int8)


def n_buckets(types: int) -> int:
    """Buckets for so many distinct words: a power of two that grows with their root."""
    return 1 << max(4, types.bit_length() // 2 - LESS)


class Code:
    """Leaf numbers of tokens and their code: 0 is the end, then the buckets, then words by falling count.

    ``rest``: (tokens, distinct words) of each bucket.
    """

    def __init__(self, words: list[tuple[bytes, int]], ends: int, rest: np.ndarray):
        words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.mask = len(rest) - 1
        self.first = 1 + len(rest)
        self.number = {w: k for k, (w, _) in enumerate(words, self.first)}
        self.inner = self.first + len(words)  # more than the inner nodes of the code
        self.start, self.nodes, self.bits = huffman([ends + 0.5, *(rest[:, 0] + 0.5), *(c for _, c in words)])
        self.sizes = np.diff(self.start)
        # A context's states for LEVELS places in a row lie together: a group, keyed by its first
        # node, and the place of the path's node in the group's tree.
        place = np.arange(len(self.nodes)) - np.repeat(self.start[:-1], self.sizes)
        level = place % LEVELS
        within = np.ones(len(self.nodes), np.int64)
        for k in range(1, LEVELS):
            deep = np.flatnonzero(level >= k)
            within[deep] = within[deep] * 2 + self.bits[deep - level[deep] + k - 1]
        # one number for each place: node, place in its group, bit, place of the path
        self.packed = self.nodes | within << 24 | self.bits.astype(np.int64) << 32 | np.minimum(place, PLACES - 1) << 34
        self.heads = np.ceil(self.sizes / LEVELS).astype(np.int64)  # groups on each path
        self.head = np.append(0, np.cumsum(self.heads)[:-1])
        self.keyed = ((self.nodes[level == 0] + 1) * 0x9E3779B1).astype(np.uint32)
        self.in_group = np.diff(np.append(np.flatnonzero(level == 0), len(level)))  # bits of each group
        self.totals = np.log10(rest[:, 0] + rest[:, 1] + 1.0)

    def bucket(self, word: bytes) -> int:
        return zlib.crc32(word) & self.mask


class Numbers(dict):
    """Leaf of each word; words outside the code are remembered, up to ``MEMO`` of them."""

    def __init__(self, code: Code):
        super().__init__(code.number)
        self.code = code

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
            self.update(self.code.number)
        k = self[word] = 1 + self.code.bucket(word)
        return k


def with_ends(number: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of the words of texts with an end (0) behind each text, and the start of each text, and the end of all."""
    out = np.zeros(len(number) + len(lengths), np.int64)
    out[np.arange(len(number)) + np.repeat(np.arange(len(lengths)), lengths)] = number
    return out, np.append(0, np.cumsum(lengths + 1))


def contexts(code: Code, number: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's contexts; ``begin``: starts of texts and the end of all."""
    n = len(number)
    first = np.repeat(begin[:-1], np.diff(begin))
    at = np.arange(n)
    shifted = lambda k: np.where(at - k >= first, number[np.maximum(at - k, 0)], -1)
    one, two = shifted(1), shifted(2)
    # the last function word before each token, and the one before that
    f = (number >= code.first) & (number < code.first + FUNCTION_WORDS)
    last = np.maximum.accumulate(np.where(f, at, -1)) if n else at
    before = np.append(-1, last[:-1]) if n else at
    before = np.where(before >= first, before, -1)
    earlier = np.where(before > 0, np.append(-1, last)[np.maximum(before, 0)], -1)
    earlier = np.where(earlier >= first, earlier, -1)
    fone, ftwo = np.where(before >= 0, number[before], -1), np.where(earlier >= 0, number[earlier], -1)

    def mixed(k: int, *parts) -> np.ndarray:
        h = np.full(n, k, np.uint64)
        for p in parts:
            h = (h + (p + 2).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(16)).astype(np.uint32)

    return [mixed(1, one), mixed(2, one, two), mixed(3, fone, ftwo), mixed(4, two)]


def spread(code: Code, number: np.ndarray, hashes: list[np.ndarray], at: np.ndarray, bits: int):
    """Bits of the tokens ``at``: (how many of each token, value, place, slots[INPUTS])."""
    leaf = number[at]
    size, heads = code.sizes[leaf], code.heads[leaf]
    ends, tops = np.cumsum(size), np.cumsum(heads)
    x = code.packed[np.repeat(code.start[leaf] - ends + size, size) + np.arange(ends[-1])]
    # the groups of all paths, and their bits
    group = np.repeat(code.head[leaf] - tops + heads, heads) + np.arange(tops[-1])
    keyed, in_group = code.keyed[group], code.in_group[group]
    within, right = x >> 24 & 0xFF, np.uint32(32 - bits + LEVELS)
    slots = [x & 0xFFFFFF]
    for c in hashes:
        h = np.repeat(c[at], heads)
        h ^= keyed
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0xC2B2AE35)
        h >>= right
        s = np.repeat(h.astype(np.int64) << LEVELS, in_group)
        s |= within
        slots.append(s)
    return size, x >> 32 & 1, x >> 34, slots


def pooled(batches, most: int = POOL_TOKENS):
    """Groups of (doc_id, tokens, bytes) with about ``most`` tokens."""
    some, size = [], 0
    for batch in batches:
        for part in shared.parts(batch):
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                w = tokens(t)
                some.append((i, w, len(t or b"")))
                size += len(w) + 1
                if size > most:
                    yield some
                    some, size = [], 0
    if some:
        yield some


def numbered(numbers: Numbers, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], np.int64)
    return with_ends(np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(lengths.sum())), lengths)


def table_bits(n_tokens: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(2, n_tokens))) - 2, LEAST_BITS, MOST_BITS))


COUNTS = "input int, block int, part int, counts binary"


def predictor_counts(docs: DataFrame, code, bits: int) -> DataFrame:
    """(input, block, part, counts): ones and zeros by slot, a row for each block that a task filled."""
    entries = 1 << BLOCK_BITS

    def work(batches):
        import zstandard
        from pyspark import TaskContext

        z, c, part = zstandard.ZstdCompressor(level=1), code.value, TaskContext.get().partitionId()
        numbers = Numbers(c)
        totals = [np.zeros(((c.inner if k == 0 else 1 << bits) + entries - 1) // entries * entries * 2, np.int32) for k in range(INPUTS)]
        for some in pooled(batches):
            number, begin = numbered(numbers, [w for _, w, _ in some])
            hashes = contexts(c, number, begin)
            for lo in range(0, len(number), COUNT_TOKENS):
                _, bit, _, slots = spread(c, number, hashes, np.arange(lo, min(len(number), lo + COUNT_TOKENS)), bits)
                for t, s in zip(totals, slots, strict=True):
                    np.add.at(t, s * 2 + bit, np.int32(1))
        rows = []
        for k, t in enumerate(totals):
            for b in range(len(t) // entries // 2):
                data = t[b * entries * 2 : (b + 1) * entries * 2]
                if data.any():
                    rows.append((k, b, part, z.compress(data.tobytes())))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kinds[j]) for j in range(4)], names=["input", "block", "part", "counts"])

    return docs.select("doc_id", "text").mapInArrow(shared.tidy(work), COUNTS)


def summed(counts: DataFrame, n: int) -> DataFrame:
    """Counts summed by input, block and part, as sorted streams."""
    entries = 1 << BLOCK_BITS

    def add(batches):
        import zstandard

        z, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        key, total = None, None

        def out():
            low = total.astype(np.int32) if total.max() < 2**31 else total
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, pack.compress(low.tobytes())), kinds, strict=True)], names=["input", "block", "part", "counts"])

        for batch in batches:
            for *of, data in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if of != key:
                    if key is not None:
                        yield out()
                    key, total = of, np.zeros(entries * 2, np.int64)
                raw = z.decompress(data)
                total += np.frombuffer(raw, np.int32 if len(raw) == entries * 8 else np.int64)
        if key is not None:
            yield out()

    by = ["input", "block", "part"]
    return counts.repartition(n, *by).sortWithinPartitions(*by).mapInArrow(add, COUNTS)


def predictors(docs: DataFrame, code, bits: int, n_tokens: int, base: str, name: str, more: DataFrame | None = None, level_tokens: int = LEVEL_TOKENS) -> DataFrame:
    """Counts of ``docs`` (and ``more``), one row for each block: a tree of sums, so that no task adds up the blocks of all tasks."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = predictor_counts(docs, code, bits)
    firsts = 1 + n_tokens // level_tokens
    if firsts > 1:
        counts = shared.stored(summed(counts.withColumn("part", F.pmod("part", F.lit(firsts))), n), f"{name}_parts", base)
    if more is not None:
        counts = counts.unionByName(more)
    return shared.stored(summed(counts.withColumn("part", F.lit(0)), n), name, base)


_TABLES: dict = {}


def _parquet(folder: str):
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = shared.filesystem(folder)
    for f in sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.path.endswith(".parquet")):
        with fs.open_input_file(f) as file:
            yield pq.read_table(file)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """State of each slot: the log odds of a one, drawn to 0 by few counts, in whole steps of 1 / SCALE."""
    zero, one = counts[0::2], counts[1::2]
    n = zero + one
    odds = np.clip(np.log((one + 0.4) / (zero + 0.4)) * (n / (n + 1.5)), -CLIP, CLIP)
    return np.rint(odds * SCALE).astype(np.int8)


def tables(folder: str, nodes: int, bits: int) -> list[np.ndarray]:
    """The predictors' states, kept by each worker."""
    if _TABLES.get("of") != folder:
        import zstandard

        _TABLES.clear()
        z, entries = zstandard.ZstdDecompressor(), 1 << BLOCK_BITS
        out = [np.zeros(((nodes if k == 0 else 1 << bits) + entries - 1) // entries * entries, np.int8) for k in range(INPUTS)]
        for t in _parquet(folder):
            for k, b, data in zip(t.column("input").to_pylist(), t.column("block").to_pylist(), t.column("counts").to_pylist(), strict=True):
                raw = z.decompress(data)
                out[k][b * entries : (b + 1) * entries] = log_odds(np.frombuffer(raw, np.int32 if len(raw) == entries * 8 else np.int64).astype(np.float64))
        _TABLES.update({"of": folder, "tables": out})
    return _TABLES["tables"]


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


MIDDLE = squash(np.linspace(-CLIP, CLIP, BUCKETS))


def first_fit() -> tuple[np.ndarray, np.ndarray]:
    """(weights by gate, refined probability by place and bucket) before any fit."""
    return np.full((GATES, INPUTS), 0.3), np.tile(MIDDLE, PLACES)


def run(code: Code, states, fit, number: np.ndarray, begin: np.ndarray, bits: int, lanes: int = LANES, learned=None) -> np.ndarray:
    """log10 probability of the code bits of texts (leaves with ends; ``begin``: starts, and the end of all).

    Texts run side by side in lanes; a lane that is done takes the next text, and starts from
    ``fit``. ``learned`` (weights by bits, bits, ones, alls; whole numbers) takes in what each text ends with.
    """
    w0, refined = fit
    w0, refined = w0.T.astype(np.float32), refined.astype(np.float32) * np.float32(REFINE_INERTIA)
    lengths, cells = np.diff(begin), PLACES * BUCKETS
    order = np.argsort(-lengths, kind="stable")  # long ones first, so that lanes end together
    hashes = contexts(code, number, begin)
    lanes = min(lanes, len(lengths))
    w = np.tile(w0, (1, lanes))  # input by lane * GATES + gate
    ones, alls = np.zeros((2, lanes * cells), np.float32)
    seen = np.zeros(lanes * GATES)
    doc, pos, total = order[:lanes].copy(), np.zeros(lanes, np.int64), np.zeros(lanes)
    out, after = np.zeros(len(lengths)), lanes
    active = np.arange(lanes)
    while len(active):
        d, p = doc[active], pos[active]
        take = np.minimum(np.clip(p, 1, STEP), lengths[d] - p)
        lane = np.repeat(active, take)
        at = np.repeat(begin[d] + p - (np.cumsum(take) - take), take) + np.arange(len(lane))
        size, bit, place, slots = spread(code, number, hashes, at, bits)
        of = np.repeat(lane, size)
        x = np.empty((INPUTS, len(bit)), np.float32)
        for k in range(INPUTS):
            np.multiply(states[k][slots[k]], np.float32(1 / SCALE), out=x[k])
        key = of * GATES + 2 * place + (x[2] != 0)
        odds = x[0] * w[0][key]
        for k in range(1, INPUTS):
            odds += x[k] * w[k][key]
        q = 1 / (1 + np.exp(-np.clip(odds, -20, 20)))
        b = bit.astype(np.float32)
        err = b - q
        cell = place * BUCKETS + np.rint((np.clip(odds, -CLIP, CLIP) + np.float32(CLIP)) * np.float32((BUCKETS - 1) / (2 * CLIP))).astype(np.int64)
        own = of * cells + cell
        r = (refined[cell] + ones[own]) / (np.float32(REFINE_INERTIA) + alls[own])
        q = np.clip(np.float32(0.5) * (q + r), np.float32(1e-6), np.float32(1 - 1e-6))
        bits_of = np.add.reduceat(size, np.cumsum(take) - take)
        total[active] += np.add.reduceat(np.log10(np.abs(1 - b - q)), np.cumsum(bits_of) - bits_of, dtype=np.float64)
        np.add.at(ones, own, b)
        np.add.at(alls, own, np.float32(1))
        n = np.bincount(key, minlength=lanes * GATES)
        rate = ONLINE_RATE / (n + ONLINE_INERTIA)
        for k in range(INPUTS):
            w[k] += rate * np.bincount(key, err * x[k], lanes * GATES)
        if learned is not None:
            seen += n
        p = pos[active] = p + take
        done = active[p == lengths[d]]
        if len(done):
            out[doc[done]] = total[done]
            if learned is not None:
                gates = (done[:, None] * GATES + np.arange(GATES)).ravel()
                learned[0] += np.rint(w[:, gates] * seen[gates] * UNIT).astype(np.int64).reshape(INPUTS, -1, GATES).sum(1)
                learned[1] += seen[gates].astype(np.int64).reshape(-1, GATES).sum(0)
                learned[2] += ones.reshape(lanes, cells)[done].astype(np.int64).sum(0)
                learned[3] += alls.reshape(lanes, cells)[done].astype(np.int64).sum(0)
            new = done[: len(order) - after]
            doc[new], pos[new], total[done] = order[after : after + len(new)], 0, 0
            after += len(new)
            w.reshape(INPUTS, lanes, GATES)[:, new] = w0[:, None]
            seen.reshape(lanes, GATES)[new] = 0
            ones.reshape(lanes, cells)[new] = 0
            alls.reshape(lanes, cells)[new] = 0
            active = active[pos[active] < lengths[doc[active]]]
    return out


def fit_mixer(docs: DataFrame, code, folder: str, bits: int, rounds: int = FIT_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights by gate, refined probability by place and bucket) from ``docs``.

    What comes back are sums of whole numbers of a fixed size, so the result doesn't depend on partitions.
    """
    fit = first_fit()
    sizes = [INPUTS * GATES, GATES, PLACES * BUCKETS, PLACES * BUCKETS]
    ends = np.cumsum([0, *sizes])

    def work(batches):
        c = code.value
        states, numbers = tables(folder, c.inner, bits), Numbers(c)
        learned = [np.zeros((INPUTS, GATES), np.int64), *(np.zeros(s, np.int64) for s in sizes[1:])]
        for some in pooled(batches):
            number, begin = numbered(numbers, [x for _, x, _ in some])
            run(c, states, fit, number, begin, bits, learned=learned)
        flat = np.concatenate([x.ravel() for x in learned])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "total"])

    for _ in range(rounds):
        # by decimal, since weights times bits times UNIT outgrow long on large corpora
        found = docs.select("doc_id", "text").mapInArrow(shared.tidy(work), "at int, total long").groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        flat = np.zeros(ends[-1])
        for r in found:
            flat[r.at] = float(r.total)
        w, n, ones, alls = (flat[a:b] for a, b in zip(ends, ends[1:], strict=False))
        w0 = np.where(n > 0, w.reshape(INPUTS, GATES) / (np.maximum(n, 1) * UNIT), fit[0].T).T
        fit = w0, (ones + 20 * fit[1]) / (alls + 20)
    return fit


class Known:
    """Places of the dictionary's words: leaf, log10 of count and one, and log10 of the share in the leaf; the last place is for others."""

    def __init__(self, code: Code, folder: str):
        self.code, self.place, leaf, counts = code, {}, [], []
        for t in _parquet(folder):
            for w, c in zip(t.column("word").to_pylist(), t.column("c").to_pylist(), strict=True):
                self.place[w] = len(leaf)
                leaf.append(code.number.get(w) or 1 + code.bucket(w))
                counts.append(c)
        leaf = np.array([*leaf, 0])
        self.leaf, self.logs = leaf, np.log10(np.array([*counts, 0], float) + 1)
        self.price = np.where(leaf < code.first, self.logs - code.totals[np.clip(leaf - 1, 0, code.mask)], 0.0)

    def places(self, texts: list[list[bytes]], n: int) -> np.ndarray:
        last = len(self.leaf) - 1
        get = self.place.get
        return np.fromiter((get(w, last) for w in chain.from_iterable(texts)), np.int64, n)


def scored(docs: DataFrame, level_tokens: int = LEVEL_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    shared.ship(spark)
    base = shared.shared_dir(spark)
    rows = _rows(docs)
    ends = rows.filter(F.col("fold") != HELD_OUT).count()
    words = vocabulary(docs, base)
    used, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_all, v_all = used + ends, distinct + (ends > 0)
    least = least_octave(words, CODED)
    listed = [(bytes(r.word), r.c) for r in words.filter(_octave() >= least).collect()]
    rest = np.zeros((n_buckets(distinct), 2), np.int64)
    of = F.col("word").cast("binary")
    for r in words.filter(_octave() < least).groupBy(F.crc32(of).bitwiseAND(F.lit(len(rest) - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("u")).collect():
        rest[r.b] = r.c, r.u
    code = spark.sparkContext.broadcast(Code(listed, ends, rest))  # CODED words at most, and the buckets
    bits = table_bits(n_all)
    main = predictors(rows.filter(~F.col("fold").isin(HELD_OUT, FIT)), code, bits, n_all, base, "counts", level_tokens=level_tokens)
    fold = rows.filter(F.col("fold") == FIT)
    fit = fit_mixer(fold, code, f"{base}/counts", bits)
    predictors(fold, code, bits, n_all, base, "all_counts", main, level_tokens)
    shared.stored(words.filter(_octave() >= least_octave(words, KNOWN)), "known", base)

    def work(batches):
        from pyspark import TaskContext

        cc, row = code.value, TaskContext.get().partitionId() << 40
        states = tables(f"{base}/all_counts", cc.inner, bits)
        if "known" not in _TABLES:
            _TABLES["known"] = Known(cc, f"{base}/known")
        known = _TABLES["known"]
        for some in pooled(batches):
            texts = [w for _, w, _ in some]
            lengths = np.array([len(t) for t in texts], np.int64)
            at = known.places(texts, int(lengths.sum()))
            of = np.repeat(np.arange(len(some)), lengths)
            leaf, price = known.leaf[at], known.price[at]
            rest: list[Counter] = [Counter() for _ in some]
            lost = np.flatnonzero(at == len(known.leaf) - 1)
            flat = list(chain.from_iterable(texts)) if len(lost) else []
            for k, d in zip(lost.tolist(), of[lost].tolist(), strict=True):
                b = cc.bucket(flat[k])
                leaf[k], price[k] = 1 + b, -cc.totals[b]
                rest[d][flat[k]] += 1
            number, begin = with_ends(leaf, lengths)
            coded = run(cc, states, fit, number, begin, bits)
            sum_of = lambda values: np.bincount(of, values, len(some))
            out = [
                pa.array(range(row, row + len(some)), pa.int64()),
                pa.array([i for i, _, _ in some], pa.int64()),
                pa.array([remainder(i) == HELD_OUT for i, _, _ in some], pa.bool_()),
                pa.array(lengths + 1),
                pa.array(lengths - np.bincount(of[lost], minlength=len(some))),
                pa.array(sum_of(known.logs[at])),
                pa.array(coded + sum_of(price)),
                pa.array([size for _, _, size in some], pa.int64()),
                pa.array([list(r) for r in rest], pa.list_(pa.binary())),
                pa.array([list(r.values()) for r in rest], pa.list_(pa.int64())),
            ]
            row += len(some)
            yield pa.RecordBatch.from_arrays(out, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "n_bytes", "words", "times"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, n_bytes long, words array<binary>, times array<long>"
    made = shared.stored(rows.select("doc_id", "text").mapInArrow(shared.tidy(work), schema), "scored", base)
    # Words that the dictionary lacks: their counts come from the whole vocabulary. Whole numbers again.
    away = made.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word").join(words, "word")
    away = away.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.round(F.log10(F.col("c").cast("double") + 1) * UNIT).cast("long")).alias("more_logs"))
    end_logs, per_token = float(np.log10(ends + 1)), float(np.log10(n_all + v_all + 1))
    more, more_logs = F.coalesce("more", F.lit(0)), F.coalesce(F.col("more_logs") / F.lit(float(UNIT)), F.lit(0.0))
    return (
        made.drop("words", "times")
        .join(away, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("n_known") + more + F.lit(1 if ends else 0)).alias("n_known"),
            F.lit(int(n_all)).cast("long").alias("train_tokens"),
            (F.col("logs") + more_logs + F.lit(end_logs) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
            (F.col("score") + more_logs).alias("score"),
            "n_bytes",
        )
        .withColumn("bits_per_byte", -F.col("score") / F.lit(float(np.log10(2.0))) / F.greatest("n_bytes", F.lit(1)))
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
