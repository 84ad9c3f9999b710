"""Quality classifier from weak labels.

Eight heuristic labellers each call a text bad (1), good (0) or abstain; two of them abstain on texts of fewer
than ``SHORT`` words, where a share of words says little. Expectation maximisation
over the counts of vote patterns (at most 3 ** 8 rows, from all documents) estimates the share of
bad texts and each labeller's chance of calling a bad or good text bad, and so the posterior of
every pattern. The posteriors are the soft labels of a linear scorer over hashed features: shapes
of words and of neighbouring words. It is trained by gradient descent on the driver from at most
``SAMPLE`` documents with ``VALUES`` feature values in all (drawn by a hash of doc_id); everything else covers all documents. A text is
rejected when its score, the probability of being bad, is above ``REJECT``.

Documents are read twice, in Arrow batches without a shuffle: once for votes and the sample's
features, once to be scored with the weights, which have a fixed size.

Null and empty texts and texts without words are not voted on; their score is 1 and they are
rejected. A null doc_id is never in the sample. Repeated rows get equal scores. Long texts are voted on
and scored whole. An empty table trains a model that scores 0.5, and gives no rows. Columns _score and
_keep are replaced where they exist; no other column is touched, whatever its name.
"""

from __future__ import annotations

import itertools
import operator
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SAMPLE, VALUES = 20_000, 6_000_000
BUCKETS = 4096
REJECT = 0.85
EM_ROUNDS, STEPS = 100, 300
#: Texts of fewer words than this get abstentions from labellers that need a rate.
SHORT = 20
#: Words are looked for again within blocks of this many, since any long text repeats its words.
BLOCK = 100

_SYMBOLS = re.compile(r"(?:[#$%&*@^~=+<>_-]{3,}|\|)(?!\S)")
_PLAIN = re.compile(r"\w+[.,;:!?]?")


def labels(words: list[str], text: str) -> list[int]:
    """Votes of the eight labellers: 1 bad, 0 good, -1 abstains."""
    n = len(words)

    def rate(x: float, bad: float, good: float) -> int:
        return 1 if x > bad else 0 if x < good else -1

    bars = text.count("|")
    plain = [w for w, before in zip(words, ["", *words], strict=False) if w != before and _PLAIN.fullmatch(w)]
    short = sum(1 for w in plain if len(w) <= 3 and w.islower())
    twice = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    votes = [
        rate(sum(map(str.isupper, words)) / n, 0.25, 0.08),  # shouting
        rate(text.count("!!") / n, 0.15, 0.02),  # exclamations
        rate(len(_SYMBOLS.findall(text)) / n, 0.15, 0.03),  # symbol runs and bars
        rate(bars / n, 0.12, 0.02),  # bar-separated lists
        rate(twice / n, 0.25, 0.05),  # a word after itself
        rate(1 - len(plain) / n, 0.3, 0.1),  # few ordinary words; one after itself isn't
        rate(1 - short / n, 0.88, 0.75) if n >= SHORT else -1,  # few short words
        rate(sum(len(b) - len(set(b)) for b in itertools.batched(words, BLOCK)) / n, 0.5, 0.3) if n >= SHORT else -1,  # few different words
    ]
    return votes


_SHAPE = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "0" if chr(c).isdigit() else chr(c) for c in range(0x250)}


class Shapes(dict):
    """Number of a word's shape: runs of upper case, lower case, digits and symbols; bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        shape = re.sub(r"(.)\1+", r"\1\1", word.translate(_SHAPE))
        n = self[word] = zlib.crc32(shape.encode("utf-8", "surrogatepass"))
        return n


_SHAPES = Shapes()


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text: roots of the shares of its word shapes, shape pairs and repeats."""
    h = np.fromiter(map(_SHAPES.__getitem__, words), np.uint64, len(words))
    pairs = shared.mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    same = np.fromiter(map(operator.eq, words, itertools.islice(words, 1, None)), bool, len(words) - 1)
    ids = np.concatenate([shared.mix64(h), pairs, np.full(int(same.sum()), 77, np.uint64)]) % np.uint64(BUCKETS)
    idx, n = np.unique(ids.astype(np.int32), return_counts=True)
    return idx, np.sqrt(n / len(words)).astype(np.float32)


def fit_label_model(patterns: dict[str, int], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[tuple[float, float]], float]:
    """Posterior of each vote pattern, (hit rate on bad, on good) of each labeller, share of bad texts."""
    keys = sorted(patterns)
    if not keys:
        return {}, [], 0.0
    v = np.array([[int(x) - 1 for x in k] for k in keys])
    n = np.array([patterns[k] for k in keys], float)
    hit, false, prior = np.full(v.shape[1], 0.6), np.full(v.shape[1], 0.03), 0.15
    said, yes = v >= 0, v == 1
    for _ in range(rounds):
        a = np.log(prior) + np.where(said, np.where(yes, np.log(hit), np.log(1 - hit)), 0).sum(1)
        b = np.log(1 - prior) + np.where(said, np.where(yes, np.log(false), np.log(1 - false)), 0).sum(1)
        p = 1 / (1 + np.exp(np.clip(b - a, -60, 60)))
        bad, good = (n * p)[:, None], (n * (1 - p))[:, None]
        prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 0.5))
        hit = ((bad * yes).sum(0) + 0.6) / ((bad * said).sum(0) + 1)
        false = ((good * yes).sum(0) + 0.03) / ((good * said).sum(0) + 1)
    return dict(zip(keys, p.tolist(), strict=True)), list(zip(hit.tolist(), false.tolist(), strict=True)), prior


def fit_scorer(idx: np.ndarray, val: np.ndarray, sizes: np.ndarray, y: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of soft labels ``y``; rows of ``sizes`` features lie in a row in ``idx`` and ``val``."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(y):
        return w, bias
    row = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    m = np.zeros(BUCKETS + 1)
    s = np.zeros(BUCKETS + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(np.bincount(row, val * w[idx], len(y)) + bias)))
        g = np.append(np.bincount(idx, val * (p - y)[row], BUCKETS) / len(y) + 1e-5 * w, (p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def train(docs: DataFrame, sample: int = SAMPLE, values: int = VALUES) -> dict:
    """weights, bias, posteriors by pattern, labellers and prior, from all documents' votes."""
    spark = docs.sparkSession
    shared.ship(spark)
    limit = int(min(1.0, sample / max(1, docs.count())) * 2**32)

    def vote(batches):
        for batch in (part for whole in batches for part in shared.parts(whole)):
            ids, draws, pats, idxs, vals = [], [], [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (t or "").split()
                if not words:
                    continue
                pats.append("".join(str(x + 1) for x in labels(words, t)))
                draw = zlib.crc32(b"sample:%d" % i) if i is not None else 2**32
                mine = draw < limit
                idx, val = features(words) if mine else (None, None)
                ids.append(i)
                draws.append(draw if mine else None)
                idxs.append(idx)
                vals.append(val)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(draws, pa.int64()), pa.array(pats, pa.string()), pa.array(idxs, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], names=["doc_id", "draw", "pattern", "idx", "val"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    voted = shared.stored(rows.mapInArrow(shared.tidy(vote), "doc_id long, draw long, pattern string, idx array<int>, val array<float>"), "votes")
    patterns = {r[0]: r[1] for r in voted.groupBy("pattern").count().collect()}
    posterior, labellers, prior = fit_label_model(patterns)
    # The sample in the order of its draws, up to the bound on its features; the driver sees sizes first.
    drawn = voted.filter("draw is not null")
    sizes = drawn.select("draw", F.size("idx").alias("n")).orderBy("draw", "n").limit(sample).toArrow()
    fits = np.cumsum(sizes.column(1).to_numpy()) <= values
    last = sizes.column(0)[int(fits.sum()) - 1].as_py() if fits.any() else -1
    part = drawn.filter(F.col("draw") <= last).orderBy("draw", "doc_id", "pattern").limit(int(fits.sum())).select("pattern", "idx", "val").toArrow().combine_chunks()
    lists = [part.column(k).combine_chunks() if part.num_rows else pa.array([], pa.list_(pa.int32() if k == 1 else pa.float32())) for k in (1, 2)]
    y = np.array([posterior[p] for p in part.column(0).to_pylist()])
    w, bias = fit_scorer(lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy(), np.asarray(lists[0].value_lengths()), y)
    return {"weights": w, "bias": bias, "posterior": posterior, "labellers": labellers, "prior": prior}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with _score, the probability of being bad, and _keep."""
    shared.ship(docs.sparkSession)
    docs = docs.drop("_score", "_keep")
    w, bias = model["weights"], model["bias"]
    fields = docs.columns
    at = fields.index("text")
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*docs.schema.fields]).add("_score", DoubleType())

    def work(batches):
        for batch in (part for whole in batches for part in shared.parts(whole)):
            out = np.ones(batch.num_rows)
            for k, t in enumerate(batch.column(at).to_pylist()):
                words = (t or "").split()
                if words:
                    idx, val = features(words)
                    out[k] = 1 / (1 + np.exp(-(float(np.dot(w[idx], val)) + bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(shared.tidy(work), schema).withColumn("_keep", F.col("_score") <= REJECT)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs)).select("doc_id", F.col("_score").alias("score"), F.col("_keep").alias("keep"))
