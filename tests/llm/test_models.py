import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers_llm import LONG, ODD, duck, empty, odd, rows, saved, text

from quillon.llm import pieces, quality, scoring, topk


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


TEXTS = ["", " ", "Hello  world\n x", "a\n\n b ", "ﬁ Å Ⅳ\t　a 日本語 😀", "the quick brown fox   jumps", "\n", "x" * 300, LONG[:500], "don't ÉCOLE|*** 12,5"]


def test_merges_equal_library(library):
    p = pieces.pieces(pieces.default_model())
    for t in TEXTS:
        ids = [i for u in pieces.units(t) for i in p.solve(u)]
        assert ids == library.encode(t)
        assert p.decode(ids).decode() == t


def test_both_folds_equal_their_recurrence(spark):
    p = pieces.pieces(pieces.default_model())
    units = sorted({u for t in TEXTS for u in pieces.units(t) if len(u) <= pieces.LONGEST})
    df = spark.createDataFrame([(u,) for u in units], "unit string")
    for kind, solve in (("bpe", p.merged), ("unigram", p.best_path)):
        got = {r.unit: [x for i in r.ids for x in ([i] if i >= 0 else p.spelled(chr(-i)))] for r in pieces.lattice(df, kind=kind).collect()}
        assert got == {u: solve(u) for u in units}


def test_best_path_is_best():
    p = pieces.pieces(pieces.default_model())
    for unit in ("▁the", "▁hello", "station", "▁qzx"):
        best = -math.inf
        for cuts in itertools.product((0, 1), repeat=len(unit) - 1):
            at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(unit)]
            parts = [unit[a:b] for a, b in zip(at, at[1:], strict=False)]
            if all(x in p.table for x in parts):
                best = max(best, sum(p.table[x][1] for x in parts))
        assert sum(p.table[p.names[i]][1] for i in p.best_path(unit)) == best


def test_encoding_query(spark, tmp_path, library):
    got = pieces.op8_sentencepiece(spark, saved(odd(spark), tmp_path)).collect()
    assert len(got) == 13 and all(r.exact for r in got)
    texts = {r[0]: r[1] for r in ODD if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id] or "")
            assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    full = pieces.encoded(odd(spark), most=3)
    assert {r.doc_id: r.ids for r in full.filter("doc_id is not null").collect()} == {i: library.encode(t or "") for i, t in texts.items()}
    assert pieces.op8_sentencepiece(spark, saved(empty(spark), tmp_path)).count() == 0


def brute_base(docs):
    toks = [(i, [*(t or "").encode().lower().split(), b""]) for i, t in docs]
    rem = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7
    c = Counter(w for i, t in toks for w in t if rem(i) != 2)
    n, v = sum(c.values()), len(c)
    return sorted([(i, rem(i) == 2, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks], key=repr)


def base_of(df):
    return sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()], key=repr)


def prose(n=400):
    r = random.Random(5)
    words = [f"word{k}" for k in range(300)]
    follow = {w: r.sample(words, 3) for w in words}
    out = []
    for i in range(n):
        w, t = r.choice(words), []
        for _ in range(r.randrange(5, 120)):
            t.append(w)
            w = r.choice(follow[w]) if r.random() < 0.8 else r.choice(words)
        out.append((i, " ".join(t)))
    return out


def test_scoring_base_and_held_out(spark):
    docs = prose()
    got = scoring.scored(spark.createDataFrame(docs, "doc_id long, text string")).cache()
    assert base_of(got) == brute_base(docs)
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) + 1e-9  # contexts help


def test_scoring_does_not_depend_on_partitions(spark):
    docs = prose(200)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    of = lambda x, **kw: {r.doc_id: (r.score, r.base_score, r.n_known) for r in scoring.scored(x, **kw).collect()}
    one = of(df(docs).repartition(1))
    assert len(one) == 200
    assert of(df(docs).repartition(4)) == one
    assert of(df(random.Random(1).sample(docs, 200)).repartition(3), level_tokens=1000) == one  # and a tree of sums


def brute_score(docs):
    """The model by loops over tokens and bits, with exact arithmetic but for the states."""
    m64, m32 = 2**64 - 1, 2**32 - 1
    toks = {i: [*t.encode().lower().split(), None] for i, t in docs}
    rem = lambda i: zlib.crc32(str(i).encode()) % 7
    train = [i for i in toks if rem(i) != 2]
    c = Counter(w for i in train for w in toks[i] if w is not None)
    nb = 1 << max(4, len(c).bit_length() // 2 - scoring.LESS)
    assert len(c) <= scoring.CODED  # all words have a leaf of their own
    code = scoring.Code(list(c.items()), len(train), np.zeros((nb, 2), np.int64))
    bits = scoring.table_bits(sum(c.values()) + len(train))
    leaf = lambda w: 0 if w is None else code.number.get(w) or 1 + zlib.crc32(w) % nb
    path = lambda n: [(int(code.nodes[k]), int(code.bits[k])) for k in range(code.start[n], code.start[n + 1])]

    def context(k, *parts):
        h = k
        for p in parts:
            h = (h + p + 2) * 0x9E3779B97F4A7C15 & m64
            h ^= h >> 29
        return (h >> 16) & m32

    def walk(i):
        """(place, bit, slots) of every bit, by token."""
        ns, words = [leaf(w) for w in toks[i]], []
        for k, n in enumerate(ns):
            one, two = (ns[k - j] if k >= j else -1 for j in (1, 2))
            f = [x for x in ns[:k] if code.first <= x < code.first + scoring.FUNCTION_WORDS][:-3:-1] + [-1, -1]
            hashes, out, p = [context(1, one), context(2, one, two), context(3, f[0], f[1]), context(4, two)], [], path(n)
            for place, (node, bit) in enumerate(p):
                level = place % scoring.LEVELS
                if not level:
                    key, within = (node + 1) * 0x9E3779B1 & m32, 1
                slots = [(0, node)]
                for j, h in enumerate(hashes, 1):
                    h = (h ^ key) * 0x85EBCA6B & m32
                    h = (h ^ h >> 15) * 0xC2B2AE35 & m32
                    slots.append((j, (h >> (32 - bits + scoring.LEVELS)) << scoring.LEVELS | within))
                out.append((min(place, scoring.PLACES - 1), bit, slots))
                within = within * 2 + bit
            words.append(out)
        return words

    def counted(ids):
        n = Counter()
        for i in ids:
            for word in walk(i):
                for _, bit, slots in word:
                    n.update((s, bit) for s in slots)
        return n

    def state(n, s):
        zero, one = n[s, 0], n[s, 1]
        x = math.log((one + 0.4) / (zero + 0.4)) * (zero + one) / (zero + one + 1.5) if zero + one else 0.0
        return round(min(8.0, max(-8.0, x)) * 127 / 8) / (127 / 8)

    squash = lambda x: 1 / (1 + math.exp(-x))

    def one_text(i, n, w0, refined):
        w, ones, alls, seen, total = {g: list(v) for g, v in w0.items()}, Counter(), Counter(), Counter(), 0.0
        words, k = walk(i), 0
        while k < len(words):
            step, k = words[k : k + min(16, max(1, k))], k + min(16, max(1, k))
            grad, hits, said = {}, Counter(), []
            for word in step:
                for place, bit, slots in word:
                    x = [state(n, s) for s in slots]
                    g = place * 2 + (x[2] != 0)
                    odds = sum(a * b for a, b in zip(w[g], x, strict=True))
                    q = squash(odds)
                    cell = (place, round((min(8.0, max(-8.0, odds)) + 8) * 2))
                    r = (refined[cell] * 60 + ones[cell]) / (60 + alls[cell])
                    total += math.log10(q / 2 + r / 2 if bit else 1 - q / 2 - r / 2)
                    grad.setdefault(g, [0.0] * 5)
                    grad[g] = [a + (bit - q) * b for a, b in zip(grad[g], x, strict=True)]
                    hits[g] += 1
                    said.append((cell, bit))
            for g, v in grad.items():
                w[g] = [a + 0.4 / (hits[g] + 30) * b for a, b in zip(w[g], v, strict=True)]
            seen.update(hits)
            for cell, bit in said:
                ones[cell] += bit
                alls[cell] += 1
        return total, w, ones, alls, seen

    main = counted([i for i in train if rem(i) != 3])
    w0 = {g: [0.3] * 5 for g in range(32)}
    refined = {(p, b): squash(-8 + b / 2) for p in range(16) for b in range(33)}
    for _ in range(scoring.FIT_ROUNDS):
        done = [one_text(i, main, w0, refined) for i in train if rem(i) == 3]
        seen = Counter()
        for *_, s in done:
            seen.update(s)
        w0 = {g: [sum(w[g][k] * s[g] for _, w, _, _, s in done) / seen[g] if seen[g] else w0[g][k] for k in range(5)] for g in w0}
        refined = {c: (sum(o[c] for _, _, o, _, _ in done) + 20 * r) / (sum(a[c] for _, _, _, a, _ in done) + 20) for c, r in refined.items()}
    n = counted(train)
    return {i: one_text(i, n, w0, refined)[0] for i in toks}  # a word without a leaf is alone in an empty bucket


def test_score_equals_brute_force(spark):
    docs = prose(60)
    got = {r.doc_id: r.score for r in scoring.scored(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()}
    want = brute_score(docs)
    assert got.keys() == want.keys()
    assert all(abs(got[i] - want[i]) < 1e-3 * abs(want[i]) for i in want)


def test_probabilities_sum_to_one():
    """After a text's beginning, the probabilities of all tokens, unseen ones as one type for each bucket, sum to 1."""
    r = random.Random(3)
    rest = np.array([[r.randrange(0, 50), r.randrange(0, 9)] for _ in range(16)])
    code = scoring.Code([(b"w%d" % k, 90 - k) for k in range(40)], 12, rest)
    rng = np.random.default_rng(4)
    states = [rng.integers(-127, 128, code.inner if k == 0 else 1 << 14).astype(np.int8) for k in range(scoring.INPUTS)]
    fit = rng.normal(0.3, 0.2, (scoring.GATES, scoring.INPUTS)), np.clip(scoring.first_fit()[1] + rng.normal(0, 0.05, scoring.PLACES * scoring.BUCKETS), 0.01, 0.99)
    start = [17 + 3, 17 + 5, 4, 17 + 3] * 10
    leaves = range(code.first + 40)
    number = np.concatenate([[*start, x] for x in leaves] + [start]).astype(np.int64)
    begin = np.append(0, np.cumsum([len(start) + 1] * len(leaves) + [len(start)]))
    s = scoring.run(code, states, fit, number, begin, 14)
    # 41 tokens: the last stands in the middle of a step, so it is predicted by the state that all share
    p = 10 ** (s[:-1] - s[-1])
    assert abs(p.sum() - 1) < 1e-4
    inside = [(c + u + 1) / 10 ** code.totals[b] for b, (c, u) in enumerate(rest)]  # sum of c + 1 over the types, and the unseen one
    assert np.allclose(inside, 1)


def test_scoring_odd_rows(spark, tmp_path):
    got = scoring.op7_lm_scoring(spark, saved(odd(spark), tmp_path)).cache()
    assert base_of(got) == brute_base([(r[0], r[1]) for r in ODD])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())
    assert scoring.op7_lm_scoring(spark, saved(empty(spark), tmp_path)).count() == 0


def test_short_texts_adapt_online():
    code = scoring.Code([(b"a", 9), (b"b", 3), (b"c", 1)], 4, np.zeros((1, 2), np.int64))
    fit = scoring.first_fit()
    for odds in (0, 40):  # nothing for the weights to learn, so the refinement alone; a predictor that is wrong at each one
        states = [np.full(code.inner if k == 0 else 1 << 14, odds if k == 0 else 0, np.int8) for k in range(scoring.INPUTS)]

        def score(*lengths, states=states, lanes=3):
            number, begin = scoring.with_ends(np.full(sum(lengths), 4), np.array(lengths))
            return scoring.run(code, states, fit, number, begin, 14, lanes)

        s = {n: float(score(n)[0]) for n in (0, 2, 4, 20, 40)}
        assert s[40] - s[20] > s[20] - s[0] + 0.1
        assert s[4] - s[2] > s[2] - s[0] + 1e-3
        for lanes in (1, 2, 3, 9):
            assert score(20, 0, 40, 2, 4, lanes=lanes).tolist() == [s[20], s[0], s[40], s[2], s[4]]


def test_code_is_a_distribution():
    code = scoring.Code([(b"a", 9), (b"b", 3), (b"c", 1)], 4, np.zeros((1, 2), np.int64))
    lengths = np.diff(code.start)
    assert abs(sum(2.0**-n for n in lengths) - 1) < 1e-12


def test_topk_against_sql(spark, tmp_path):
    r = random.Random(2)
    made = [(i, [r.uniform(-1, 1) for _ in range(24)], 0) for i in range(300)]
    made += [(1000 + i, [0.5] * 24, 0) for i in range(60)]  # ties
    made += [(2000, None, 0), (2050, [0.1, None] * 12, 0), (2100, [float("nan")] * 24, 0), (2150, [float("inf")] * 24, 0), (None, [0.5] * 24, 0), (2200, [], 0), (2250, [1.0] * 3, 0), (2251, [1.0] * 3, 0)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, score int")
    folder = saved(df, tmp_path, "embeddings")
    assert rows(topk.op9_topk(spark, folder)) == duck(topk.SQL, embeddings=df)
    assert topk.nearest(df.limit(0)).count() == 0


def test_topk_of_large_values(spark):
    r = random.Random(6)
    made = [(i, [r.choice((70000.00390625, 70000.0, 1e5 / 3, -4e5)) * r.random() for _ in range(20)]) for i in range(150)] + [(50, [70000.00390625] * 20), (151, [70000.00390625] * 20), (152, [70000.0] * 20)]
    made = [m for k, m in enumerate(made) if k == 150 or m[0] != 50]
    made += [(i, [r.uniform(-1e6, 1e6) for _ in range(18)]) for i in range(1000, 1060)]  # scores beyond 2 ** 53
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    assert rows(topk.nearest(df)) == duck(topk.SQL, embeddings=df)
    with pytest.raises(Exception, match="64 bits"):
        topk.nearest(spark.createDataFrame([(50, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()


def test_topk_repeated_rows(spark):
    df = spark.createDataFrame([(50, [1.0]), (50, [1.0]), (1, [0.5]), (1, [0.5]), (2, [0.5])], "vec_id long, embedding array<float>")
    assert rows(topk.nearest(df)) == sorted([(50, 1, 32768, 1), (50, 2, 32768, 1), (50, 3, 32768, 2)])


def test_label_model_finds_the_rare_class():
    patterns = {"1" * 8: 900, "2" * 8: 40, "22111222": 30, "11222222": 30}
    posterior, labellers, prior = quality.fit_label_model(patterns)
    assert posterior["1" * 8] < 0.01 and min(posterior[k] for k in patterns if "2" in k) > 0.99 and 0.05 < prior < 0.2
    assert quality.fit_label_model({}) == ({}, [], 0.0)


def own_votes(t):
    """Votes of a text by loops over words and characters."""
    words = t.split()
    n = len(words)
    bare = lambda w: w[:-1] if len(w) > 1 and w[-1] in ".,;:!?" else w
    plain = [w for k, w in enumerate(words) if (k == 0 or words[k - 1] != w) and all(c.isalnum() or c == "_" for c in bare(w))]
    noise = sum(1 for w in words if w[-1] == "|" or (len(w) > 2 and all(c in "#$%&*@^~=+<>_-" for c in w[-3:])))
    marks = sum(w.count("!") // 2 for w in words)  # runs of one word here
    again = sum(1 for k in range(n) if words[k] in words[k - k % 100 : k])
    seen = [
        (sum(1 for w in words if w.upper() == w != w.lower()) / n, 0.25, 0.08),
        (marks / n, 0.15, 0.02),
        (noise / n, 0.15, 0.03),
        (sum(1 for c in t if c == "|") / n, 0.12, 0.02),
        (sum(1 for k in range(1, n) if words[k] == words[k - 1]) / n, 0.25, 0.05),
        (1 - len(plain) / n, 0.3, 0.1),
        (1 - sum(1 for w in plain if len(w) < 4 and w == w.lower() != w.upper()) / n, 0.88, 0.75),
        (again / n, 0.5, 0.3),
    ]
    # 2 bad, 1 good, 0 abstains
    return "".join("0" if n < 20 and k > 5 else "2" if x > bad else "1" if x < good else "0" for k, (x, bad, good) in enumerate(seen))


def own_posteriors(patterns):
    """EM over documents, one by one."""
    hit, false, prior = [0.6] * 8, [0.03] * 8, 0.15
    for _ in range(quality.EM_ROUNDS):
        p = {}
        for v in patterns:
            a, b = prior, 1 - prior
            for k, c in enumerate(v):
                a *= {"0": 1, "1": 1 - hit[k], "2": hit[k]}[c]
                b *= {"0": 1, "1": 1 - false[k], "2": false[k]}[c]
            p[v] = a / (a + b)
        prior = min(0.5, max(1e-4, sum(n * p[v] for v, n in patterns.items()) / sum(patterns.values())))
        share = lambda k, start, of: (start + sum(n * of(v) for v, n in patterns.items() if v[k] == "2")) / (1 + sum(n * of(v) for v, n in patterns.items() if v[k] != "0"))
        hit, false = [share(k, 0.6, p.get) for k in range(8)], [share(k, 0.03, lambda v: 1 - p[v]) for k in range(8)]
    return p


def own_features(t):
    words, out = t.split(), Counter()

    def number(w):
        kind = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
        return zlib.crc32("".join(c for k, c in enumerate(kind) if kind[max(0, k - 2) : k] != [c, c]).encode())

    def mixed(x):
        x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD % 2**64
        x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 % 2**64
        return (x ^ x >> 33) % quality.BUCKETS

    for k, w in enumerate(words):
        out[mixed(number(w))] += 1
        if k:
            out[mixed((number(words[k - 1]) * 0x9E3779B97F4A7C15 + number(w)) % 2**64)] += 1
            out[77] += w == words[k - 1]
    return {k: math.sqrt(n / len(words)) for k, n in out.items() if n}


def test_scorer_equals_plain_loops(spark):
    """The scores of a small table, by votes, posteriors, features and weights of the test's own."""
    docs = [(i, text(i, 40 + i)) for i in range(30)] + [(30 + i, "||| ### %%% LOUD LOUD LOUD !! | | " * 9) for i in range(8)]
    docs += [(38, "x" * 40 + "-" + "Y" * 40 + " one two " + text(5, 30)), (39, text(7, 900)), (40, "few words, no more")]
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string")
    got = {r.doc_id: r._score for r in quality.score(df, quality.train(df)).collect()}
    pats = {i: own_votes(t) for i, t in docs}
    posterior = own_posteriors(Counter(pats.values()))
    feats = {i: own_features(t) for i, t in docs}
    y = {i: posterior[pats[i]] for i in pats}
    w, bias, m, s = Counter(), 0.0, Counter(), Counter()
    squash = lambda i: 1 / (1 + math.exp(-sum(v * w[k] for k, v in feats[i].items()) - bias))
    for t in range(1, quality.STEPS + 1):
        g = Counter({k: 1e-5 * w[k] for k in w})
        for i in feats:
            e = (squash(i) - y[i]) / len(feats)
            g[-1] += e
            for k, v in feats[i].items():
                g[k] += v * e
        for k in {*g, *m}:
            m[k], s[k] = 0.9 * m[k] + 0.1 * g[k], 0.99 * s[k] + 0.01 * g[k] ** 2
            step = 0.2 * (m[k] / (1 - 0.9**t)) / (math.sqrt(s[k] / (1 - 0.99**t)) + 1e-9)
            if k == -1:
                bias -= step
            else:
                w[k] -= step
    assert all(abs(got[i] - squash(i)) < 1e-4 for i in got)
    assert {i for i in got if got[i] > quality.REJECT} == set(range(30, 38))


def test_sample_is_bounded_by_features(spark):
    df = spark.createDataFrame([(i, text(i, 40)) for i in range(50)], "doc_id long, text string")
    full, none = quality.train(df), quality.train(df, values=0)
    assert np.any(full["weights"]) and not np.any(none["weights"]) and none["bias"] == 0
    assert np.any(quality.train(df, values=300)["weights"])


def test_quality_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    s = quality.score(docs, quality.train(docs)).join(labels, "doc_id")
    seen = {(r.quality, r._keep): r["count"] for r in s.groupBy("quality", "_keep").count().collect()}
    assert seen.get((1, False), 0) == 0 and seen.get((0, True), 0) <= 0.05 * seen[0, False]


def test_quality_odd_rows(spark):
    r = quality.score(odd(spark), quality.train(odd(spark))).collect()
    assert len(r) == 13 and {x._keep for x in r if not (x.text or "").split()} == {False}
    assert quality.score(empty(spark), quality.train(empty(spark))).count() == 0
