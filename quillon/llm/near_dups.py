"""MinHash near-dedup by an inverted join over signature coordinates.

A document's set is its distinct 5-word shingles (words lower-cased in A-Z). Its signature has
``COORDINATES`` minima. Two documents of Jaccard similarity s agree in a coordinate with
probability s, independently, so pairs at the threshold agree in ``match_threshold()`` or more of
them but for a chance below ``MISS``. A pair with t agreements of k shares a posting among the
k - t + 1 rarest coordinates of either document (prefix merging); pairs are counted over the whole
signature only then, and dropped below t (skip merging). Links that remain are confirmed on the
full sets.

Postings of copies would hold all pairs of a group. So documents of equal sets are one class from
the start, and a posting links its members to one hub at a time: after each round the confirmed
links are folded into components, a posting keeps one line for each member whose component still
differs from another's in the posting, and the next round takes another hub. Shingles that only
one of the documents in question has can't be shared; what they leave bounds the size of any
partner, and most members of a loose group then have none. After ``HUB_ROUNDS`` rounds the rest of
the pairs between different components is joined outright. A member is then written as what it lacks of
a hub and has beside it; of two with the same hub these short lists give the common shingles exactly,
so only links come out of that join, and two with different hubs meet at their first common token. Pairs
inside one component need no look: they can't change any component_id. Nothing is capped; a pair
at the threshold is lost with a probability below ``MISS`` by its signature.

Empty or null texts have no shingles and link with nothing. Fewer than five words make one
shingle. A row whose doc_id is null links with nothing but joins the component of an equal set;
kept is null for it. Classes have numbers of their own, so every set is compared, whatever ids its rows have. doc_ids name
documents: rows that share one are one document, which links the classes of all its sets (``one_document`` = False
leaves them apart). Texts are taken whole, however long. An empty
table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHINGLE = 5
COORDINATES = 64
MISS = 1e-7
HUB_ROUNDS = 2
#: Edges whose components are found in one task, without an exchange.
FEW = 50_000
#: Members of a hub that one task joins with all others of it.
GROUP = 256


def match_threshold(num: int, den: int, k: int = COORDINATES, miss: float = MISS) -> int:
    """Largest t with P(Binomial(k, num / den) < t) at most ``miss``."""
    p, total = num / den, 0.0
    for t in range(k + 1):
        total += math.comb(k, t) * p**t * (1 - p) ** (k - t)
        if total > miss:
            return t
    return k


_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(1, 2**63, 512, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 512, dtype=np.uint64)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, from strong hashes of its words."""
    h = shared.word_hashes(text.lower())  # bytes.lower() maps A-Z only
    if not len(h):
        return h
    return np.unique(shared.grams(h, min(size, len(h)), 0x9E3779B97F4A7C15 + 2 * min(size, len(h))))


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Minima per set and coordinate; sets must not be empty."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), k), np.uint32)
    for c in range(k):
        out[:, c] = np.minimum.reduceat(((flat * _MUL[c] + _ADD[c]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def signed(docs: DataFrame, k: int = COORDINATES, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the whole set, null if empty) and signature of each row."""
    shared.ship(docs.sparkSession)

    def work(batches):
        for batch in batches:
            for part in shared.parts(batch, 500):
                sets = [shingles(t or b"", size) for t in part.column(1).to_pylist()]
                full = [s for s in sets if len(s)]
                sig = iter(signatures(full, k).view(np.int32)) if full else iter(())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([next(sig) if len(s) else None for s in sets], pa.list_(pa.int32()))],
                    names=["doc_id", "n_shingles", "set_id", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(shared.tidy(work), "doc_id long, n_shingles long, set_id binary, signature array<int>")


def components(edges: DataFrame, base: str, tag: str) -> DataFrame:
    """(node, comp): smallest node reachable, for each node of ``edges`` (a, b).

    Alternates large-star and small-star steps, each a grouped minimum, until no edge changes;
    the number of rounds grows with the logarithm of the longest path. Few edges stay in one partition.
    """
    few = edges.count() <= FEW
    together = lambda df: df.coalesce(1) if few else df
    e = together(edges).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = together(shared.stored(e, f"{tag}_0", base))
    before = None
    for r in range(1, 60):
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: smaller neighbours and u itself go to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        e = together(shared.stored(small, f"{tag}_{r}", base))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components have not settled")
    return e.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")


def _agree(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)


def linked_components(classes: DataFrame, docs: DataFrame, num: int, den: int, base: str, k: int = COORDINATES, size: int = SHINGLE) -> DataFrame:
    """(node, comp): the components of the similarity graph between classes; nodes without a link are left out.

    ``classes``: rep (the class's number), doc (a doc_id that has the set), n, set_id, signature. A link holds if
    den * |intersection| >= num * |union|.
    """
    t = match_threshold(num, den, k)
    near = classes.filter("n > 0").select("rep", "n", F.posexplode("signature").alias("c", "value"))
    post = near.select("rep", "n", (F.col("c").cast("long") * F.lit(2**32) + F.col("value").cast("long") + F.lit(2**31)).alias("token"))
    often = post.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared_tokens = post.join(often, "token").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    # Tokens of one document come first in its order: they take up prefix places but match nothing.
    left = F.lit(k - t + 1) - (F.lit(k) - F.size("tokens"))
    prefix = shared_tokens.filter(left > 0).select("rep", "n", F.explode(F.slice("tokens", F.lit(1), left)).alias("x")).select("rep", "n", F.col("x.token").alias("token"))
    # Two documents that agree often have a common token in both prefixes; others' tokens there fall out.
    again = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    prefix = shared.stored(prefix.join(again, "token"), "prefix", base)
    comp = classes.sparkSession.createDataFrame([], "node long, comp long")
    if prefix.isEmpty():
        return comp
    sig = shared.stored(classes.join(prefix.select("rep").distinct(), "rep", "left_semi").select("rep", "doc", "n", "set_id", "signature"), "sig", base)
    sets = shared.stored(_sets(docs, sig, size), "sets", base)
    done = None  # pairs looked at

    def confirmed(pairs: DataFrame, tag: str) -> DataFrame:
        """Of the pairs (a, b), a < b: those that hold."""
        counted = (
            pairs.join(sig.select(F.col("rep").alias("a"), F.col("signature").alias("sa")), "a")
            .join(sig.select(F.col("rep").alias("b"), F.col("signature").alias("sb")), "b")
            .filter(_agree("sa", "sb") >= t)
            .select("a", "b")
        )
        return shared.stored(_confirm(counted, sets, num, den), f"links_{tag}", base)

    lines = prefix.select("rep", "token", "n", F.col("rep").alias("comp"), F.lit(None).cast("double").alias("most"))
    fits = lambda p, q: F.coalesce(F.col(f"{q}n") <= F.col(f"{p}most"), F.lit(True)) & F.coalesce(F.col(f"{p}n") <= F.col(f"{q}most"), F.lit(True))
    similar = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    for r in range(HUB_ROUNDS + 1):
        if r == HUB_ROUNDS:
            pairs = _rest(lines, sig, sets, similar & fits("x.", "y."), t, num, den, base)
        else:
            # hubs differ by round and token, so a member meets many of its group
            order = F.struct(F.xxhash64("rep", "token", F.lit(r)) if r else F.col("rep").cast("long"), F.col("rep"))
            y = lines.groupBy("token").agg(F.min_by(F.struct("rep", "n", "comp", "most"), order).alias("hub")).select("token", "hub.*").alias("y")
            pairs = lines.alias("x").join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & similar & fits("x.", "y."))
            pairs = pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = shared.stored(pairs, f"pairs_{r}", base)
        new = confirmed(pairs, str(r))
        done = pairs if done is None else done.unionByName(pairs)
        linked = not new.isEmpty()
        if linked:
            # components so far are stars, so only what the new links join has to move
            stars = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            comp = shared.stored(components(stars.unionByName(new), base, f"cc_{r}"), f"comp_{r}", base)
        if r == HUB_ROUNDS:
            break
        if linked:
            lines = lines.drop("comp").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        if r in BOUND_ROUNDS:
            # shingles that no other document in question has can't be in an intersection
            lines = shared.stored(_open(lines), f"open_{r}", base)
            lines = lines.drop("most").join(_largest_partner(lines, sets, num, den), "rep", "left")
        lines = shared.stored(_open(lines), f"lines_{r}", base)
        if lines.isEmpty():
            break
    return comp


#: Hub rounds after which the bound on partners' sizes is computed from what is left.
BOUND_ROUNDS = (1,)


def _open(lines: DataFrame) -> DataFrame:
    """Lines whose token still joins components, and that some other member's size allows."""
    of = lines.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("n").alias("least"))
    keep = (F.col("c1") < F.col("c2")) & F.coalesce(F.col("most") >= F.col("least"), F.lit(True))
    return lines.join(of, "token").filter(keep).select(lines.columns)


def _largest_partner(lines: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, most): no set larger than ``most`` can be linked with rep's.

    Of rep's n shingles, u are in no other set in question, so an intersection has at most n - u.
    A link with a set of m needs an intersection of num / (num + den) * (n + m) or more.
    """
    of = sets.join(lines.select("rep").distinct(), "rep", "left_semi")
    each = of.select("rep", F.explode("hashes").alias("h"))
    alone = each.groupBy("h").agg(F.min("rep").alias("rep"), F.max("rep").alias("other")).filter("rep = other")
    alone = alone.groupBy("rep").agg(F.count(F.lit(1)).alias("u"))
    n = F.size("hashes")
    return of.join(alone, "rep", "left").select("rep", ((n - F.coalesce("u", F.lit(0))) * (num + den) / num - n).alias("most"))


def _rest(lines: DataFrame, sig: DataFrame, sets: DataFrame, fit, t: int, num: int, den: int, base: str) -> DataFrame:
    """(a, b): the links between different components of members with the same hub, and the pairs to look at of those with different ones.

    A member's hub is, of the first members of its postings, the one that most others could have too.
    """
    firsts = lines.groupBy("token").agg(F.min("rep").alias("hub"))
    could = lines.join(firsts, "token").select("rep", "hub").distinct()
    often = could.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    own = could.join(often, "hub").groupBy("rep").agg(F.max_by("hub", F.struct("members", "hub")).alias("hub"))
    own = shared.stored(own, "hubs", base)
    size = own.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("deals"))
    each = lines.groupBy("rep").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.first("most").alias("most"))
    theirs = sets.select(F.col("rep").alias("hub"), F.col("hashes").alias("_hub"))
    each = each.join(own, "rep").join(size, "hub").join(sets, "rep").join(theirs, "hub")
    each = each.select("rep", "n", "comp", "most", "hub", "deals", F.size("_hub").alias("h"), F.array_except("_hub", "hashes").alias("lacks"), F.array_except("hashes", "_hub").alias("beside"))
    each = shared.stored(each, "rest", base)
    x = each.withColumn("deal", F.pmod(F.xxhash64("rep"), F.col("deals")).cast("int")).alias("x")
    y = each.withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).alias("y")
    holds = lambda both: both * (num + den) >= (F.col("x.n") + F.col("y.n")) * num
    most = F.col("x.h") - F.greatest(F.size("x.lacks"), F.size("y.lacks")) + F.least(F.size("x.beside"), F.size("y.beside"))
    both = F.col("x.h") - F.size("x.lacks") - F.size("y.lacks") + F.size(F.array_intersect("x.lacks", "y.lacks")) + F.size(F.array_intersect("x.beside", "y.beside"))
    on = (F.col("x.hub") == F.col("y.hub")) & (F.col("x.deal") == F.col("y.deal"))
    found = x.join(y, on & (F.col("x.comp") < F.col("y.comp")) & fit & holds(most) & holds(both)).select("x.rep", F.col("y.rep").alias("other"))
    # Members of different hubs meet in postings that hold several, each pair at its first common token.
    mixed = lines.join(own, "rep")
    several = mixed.groupBy("token").agg(F.min("hub").alias("h1"), F.max("hub").alias("h2")).filter("h1 <> h2").select("token")
    mixed = mixed.join(several, "token")
    tokens = mixed.groupBy("rep").agg(F.collect_set("token").alias("tokens")).join(sig.select("rep", "signature"), "rep")
    mixed = shared.stored(mixed.join(tokens, "rep"), "mixed", base)
    x, y = mixed.alias("x"), mixed.alias("y")
    apart = (F.col("x.token") == F.col("y.token")) & (F.col("x.hub") != F.col("y.hub")) & (F.col("x.comp") < F.col("y.comp")) & fit
    apart = apart & (F.array_min(F.array_intersect("x.tokens", "y.tokens")) == F.col("x.token")) & (_agree("x.signature", "y.signature") >= t)
    found = found.unionByName(x.join(y, apart).select("x.rep", F.col("y.rep").alias("other")))
    return found.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b"))


def _sets(docs: DataFrame, sig: DataFrame, size: int) -> DataFrame:
    """(rep, hashes): the full sets of the classes in ``sig``, from the texts of their documents."""

    def work(batches):
        for batch in batches:
            data = [shingles(t or b"", size) for t in batch.column(1).to_pylist()]
            own = [hashlib.blake2b(d.tobytes(), digest_size=16).digest() == s for d, s in zip(data, batch.column(2).to_pylist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.view(np.int64) for d in data], pa.list_(pa.int64()))], names=["rep", "hashes"])
            yield rows.filter(pa.array(own, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("binary").alias("text"))
    sets = texts.join(sig.select("doc", "rep", "set_id"), "doc").select("rep", "text", "set_id").mapInArrow(shared.tidy(work), "rep long, hashes array<long>")
    return sets.groupBy("rep").agg(F.first("hashes").alias("hashes"))


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links whose full sets hold the threshold."""
    a = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    b = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    # Arrays are sorted and distinct; array_intersect hashes them once.
    both = F.size(F.array_intersect("x", "y"))
    holds = both * den >= (F.size("x") + F.size("y") - both) * num
    return pairs.join(a, "a").join(b, "b").filter(holds).select("a", "b")


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, k: int = COORDINATES, size: int = SHINGLE, one_document: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, and root (the component's number; null without shingles) for each row of ``docs`` (doc_id, text).

    ``one_document``: rows that share a doc_id belong together, whatever their texts.
    """
    spark = docs.sparkSession
    base = shared.shared_dir(spark)
    rows = shared.stored(signed(docs, k, size), "signed", base)
    classes = (
        rows.filter("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    )
    classes = shared.stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes", base)
    comp = linked_components(classes, docs, num, den, base, k, size)
    several = None
    if one_document:
        # doc_ids with several sets, or with rows of and without shingles
        of = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("s1"), F.max("set_id").alias("s2"), F.bool_or(F.col("set_id").isNull()).alias("bare"))
        several = shared.stored(of.filter("s1 <> s2 or (s1 is not null and bare)").select("doc_id"), "several", base)
        several = None if several.isEmpty() else several
    if several is not None:
        of = rows.join(several, "doc_id", "left_semi").select("doc_id", "set_id").distinct().join(classes.select("set_id", "rep"), "set_id")
        ties = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("b")), "doc_id").select(F.col("rep").alias("a"), "b")
        comp = shared.stored(components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(ties), base, "ids"), "comp_ids", base)
    # a component is named after its smallest doc_id
    linked = classes.select("rep", "set_id", "doc").join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("comp", "rep"))
    names = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = linked.join(names, "root").select("set_id", "root", "component_id")
    # Rows without shingles take no part in the joins, where they would all come to one task.
    member = rows.filter("set_id is not null").join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")
    bare = rows.filter("set_id is null").select("doc_id", "n_shingles")
    if several is not None:
        own = member.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
        bare = bare.join(own, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    else:
        bare = bare.withColumn("component_id", F.col("doc_id"))
    out = member.unionByName(bare.withColumn("root", F.lit(None).cast("long")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "root")


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("root")


_SHINGLE = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER o" for k in range(1, SHINGLE))])
#: For tables without null doc_ids.
SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{shared.WORD}') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d WHERE len(ws) >= {SHINGLE}),
g AS (SELECT r, {_SHINGLE} AS shingle FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT DISTINCT r, shingle FROM g WHERE shingle IS NOT NULL UNION ALL SELECT r, array_to_string(ws, ' ') FROM d WHERE len(ws) BETWEEN 1 AND {SHINGLE - 1}),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.r <> b.r GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM l JOIN d x ON x.r = l.a JOIN d y ON y.r = l.b),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c ON c.a = doc_id LEFT JOIN n USING (r)
"""
