import hashlib
import random
from collections import defaultdict

import numpy as np
from helpers_llm import ODD, duck, empty, odd, rows, saved, text

from quillon.llm import near_dups, shared, substrings


def brute_substrings(docs, length=13):
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for i, w in split:
        for s in range(len(w) - length + 1) if i is not None else ():
            k = tuple(w[s : s + length])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1) if i is not None else ():
            if first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def shared_passages(seed, n=120):
    r = random.Random(seed)
    passages = [[f"p{p}w{k}" for k in range(r.choice((12, 13, 14, 30)))] for p in range(6)]
    docs = []
    for i in range(n):
        words = []
        for _ in range(r.randrange(4)):
            words += [f"d{i}x{r.randrange(10**6)}" for _ in range(r.randrange(25))]
            p = r.choice(passages)
            words += p if r.random() < 0.7 else p[r.randrange(3) : len(p) - r.randrange(3)]
        docs.append((i, " ".join(words)))
    return docs + docs[5:8] + [(n + 1, docs[9][1]), (None, docs[9][1])]


def test_substrings_equal_brute_force(spark):
    for seed in (1, 2):
        docs = shared_passages(seed)
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(map(tuple, substrings.dedup(df).collect()), key=repr) == brute_substrings(docs)


def test_substrings_odd_rows(spark, tmp_path):
    got = sorted(map(tuple, substrings.op5_substring_dedup(spark, saved(odd(spark), tmp_path)).collect()), key=repr)
    assert got == brute_substrings([(r[0], r[1]) for r in ODD])
    assert substrings.dedup(empty(spark)).count() == 0


def test_substrings_of_words_that_simple_hashes_confuse(spark):
    from test_shared import thue_morse

    docs = [(k, " ".join(thue_morse(n, c) + str(j) for j in range(13))) for k, (n, c) in enumerate((n, c) for n in (1024, 2048, 4096) for c in "ab")]
    docs += [(10 + k, t) for k, t in docs[:2]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, substrings.dedup(df).collect()), key=repr) == brute_substrings(docs)
    found = {r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()}
    assert found == {i: i % 10 for i, _ in docs}


def test_sql_of_both_dedups(spark, tmp_path):
    docs = [d for d in shared_passages(3) if d[0] is not None]
    docs += [(500 + i, t.replace("x1", "y1")) for i, t in docs[:20]] + [(600, "A b"), (601, "a B"), (602, ""), (603, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    folder = saved(df, tmp_path)
    assert rows(substrings.op5_substring_dedup(spark, folder)) == duck(substrings.SQL, documents=df)
    assert rows(near_dups.op4_near_dups(spark, folder)) == duck(near_dups.SQL, documents=df)


def test_sliding_min():
    x = np.array([5, 3, 8, 1, 9, 2, 7], np.uint64)
    for w in range(1, 8):
        assert substrings.sliding_min(x, w).tolist() == [min(x[k : k + w].tolist()) for k in range(len(x) - w + 1)]


def brute_components(docs, num=85, den=100):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for g in s:
            by[g].add(k)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    done = set()
    for ks in by.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if den * len(x & y) >= num * len(x | y):
                        parent[root(a)] = root(b)
    named = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            parent[root(k)] = root(named.setdefault(i, k))
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted([(i, len(s), least.get(root(k)), None if i is None else least[root(k)] == i) for k, (i, s) in enumerate(sets)], key=repr)


def near_copies(seed, n=150):
    r = random.Random(seed)
    bases = [[f"b{b}w{k}" for k in range(120)] for b in range(3)]
    docs = []
    for i in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else [f"u{i}w{k}" for k in range(r.randrange(1, 60))]
        for _ in range(r.randrange(5)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    return docs + [(n, docs[3][1].upper()), (n + 1, docs[3][1])]


def test_near_duplicates_equal_brute_force(spark):
    docs = near_copies(3)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_dups.near_duplicates(df).drop("root").collect()), key=repr) == brute_components(docs)


def test_last_join_of_a_loose_group_makes_links_only(spark, monkeypatch):
    """Copies that are all a little too different from each other aren't looked at pair by pair."""
    r, base = random.Random(8), [f"w{k}" for k in range(400)]
    docs = []
    for i in range(60):
        w = list(docs[-1][1].split()) if i % 10 == 9 else list(base)
        for k in r.sample(range(400), 1 if i % 10 == 9 else 6):
            w[k] = f"e{r.randrange(10**9)}"
        docs.append((i, " ".join(w)))
    made, stored = {}, shared.stored
    monkeypatch.setattr(shared, "stored", lambda df, name, base=None: made.setdefault(name, stored(df, name, base)))
    monkeypatch.setattr(near_dups, "HUB_ROUNDS", 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, near_dups.near_duplicates(df).drop("root").collect()), key=repr) == brute_components(docs)
    looked, links = (set(map(tuple, made[k].collect())) for k in ("pairs_1", "links_1"))
    assert looked == links


def test_near_duplicates_odd_rows(spark, tmp_path):
    got = sorted(map(tuple, near_dups.op4_near_dups(spark, saved(odd(spark), tmp_path)).collect()), key=repr)
    assert got == brute_components([(r[0], r[1]) for r in ODD])
    assert near_dups.near_duplicates(empty(spark)).count() == 0


def test_rows_that_share_a_doc_id(spark, tmp_path):
    """Every set of a doc_id is compared, and the doc_id links what they are linked with."""
    a, b, c = (text(k, 40) for k in (1, 2, 3))
    docs = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, None), (4, c), (5, c + " end"), (6, c + " end"), (6, text(6, 9)), (7, text(6, 9)), (8, ""), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, near_dups.near_duplicates(df).drop("root").collect()), key=repr)
    assert got == brute_components(docs) and {r[2] for r in got} == {1, 4, 8}
    assert rows(near_dups.op4_near_dups(spark, saved(df, tmp_path))) == duck(near_dups.SQL, documents=df)
    apart = near_dups.near_duplicates(df, one_document=False).filter("root is not null")
    assert apart.groupBy("root").count().count() == 4
    many = near_copies(5)
    many += [(i, t) for (i, _), (_, t) in zip(many[::7], many[3::11], strict=False)]
    df = spark.createDataFrame(many, "doc_id long, text string")
    assert sorted(map(tuple, near_dups.near_duplicates(df).drop("root").collect()), key=repr) == brute_components(many)


def test_match_threshold_bounds_the_miss():
    t = near_dups.match_threshold(85, 100)
    rng = np.random.default_rng(1)
    assert (rng.binomial(near_dups.COORDINATES, 0.85, 10**6) < t).sum() <= 3
    assert t > 0.5 * near_dups.COORDINATES


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(100, 101)], "a long, b long")
    got = {r.node: r.comp for r in near_dups.components(edges, shared.shared_dir(spark), "t").collect()}
    assert all(got[k] == 0 for k in range(1, 71)) and got[101] == 100


def test_short_texts_link_only_when_equal(spark):
    docs = [(1, "a b"), (2, "A B"), (3, "b a"), (4, "a b c d e"), (5, "a b c d e f"), (6, text(1, 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dups.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
