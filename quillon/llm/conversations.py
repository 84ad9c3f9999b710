"""Repair of conversations by error-correcting Earley parsing.

A weighted grammar of roles says what a conversation may be: nothing, or pairs of a user and an assistant behind
an optional system message. Error productions let a row be deleted, take another role, or be put in where it
is missing, each at a price. The parser reads a conversation's rows as symbols (role's initial and
fault) and keeps, for each chart item, the least (cost, audit): audit is the string of edits so
far, one letter each (D, I, K, R), and the least completed item spells the repair. The rules are left-recursive, so
every item starts at the first row and a column of the chart is all that the next one needs.

Rows of a conversation are taken by turn, null turns first; rows of the same turn by role, then by SHA-256 of the text. A row's first
fault counts: blank (no character beyond white space), duplicate (role and text seen earlier), truncated (the last such
character isn't one of . ! ?). Null roles and texts are one space. A null conv_id is a conversation like any other.

Conversations of up to ``LONG_ROWS`` rows and ``LONG_BYTES`` bytes are dealt by conv_id, sorted, and read one after
another. Longer ones, which may hold any share of all rows, never meet in one task: places come from ranges
(``quillon.operators.ranks``), first occurrences from a grouped minimum, and each block of ``BLOCK``
rows is parsed on its own from every item it may begin with; the least ways through the blocks
are then composed in order, which needs a few bytes of audit for each row and no text. The parse is the
same, since a column sums up all rows before it. The one thing that is sequential by its nature,
the SHA-256 of a repaired conversation's text, is taken from a sorted stream that holds one batch of rows.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import ranks

from . import shared

RULES = (
    ("Done", ()),
    ("Done", ("Closed",)),
    ("Closed", ("Open", "a")),
    ("Open", ("u",)),
    ("Open", ("Lead", "u")),
    ("Open", ("Closed", "u")),
    ("Lead", ("s",)),
)
START = "Done"
#: Roles that a row may take, or be put in with.
NAMES = {"u": "user", "a": "assistant"}
REROLE = INSERT = 3
DELETE = 4
TRUNCATED = 3
#: A row that has to go, and the mark of truncated ones (upper case): symbols of ``symbol``.
GONE = "x"
LEGAL = ("su", "ua", "au")
LONG_ROWS = 256
LONG_BYTES = 4 << 20
BLOCK = 1024

# An item is (rule, dot); every item begins at the first row. A column maps items to the least (cost, audit).
Item = tuple[int, int]
Column = dict[Item, tuple[int, str]]


def _next(item: Item) -> str | None:
    rule = RULES[item[0]][1]
    return rule[item[1]] if item[1] < len(rule) else None


_TERMINALS = frozenset("sua")
_WAITING: dict[str, list[Item]] = {}
for _k, (_, _rule) in enumerate(RULES):
    if _rule and _rule[0] not in _TERMINALS:
        _WAITING.setdefault(_rule[0], []).append((_k, 0))
#: Items that a row or the end of a block can meet: before a terminal, or complete at the start symbol.
KERNEL = [(k, d) for k, (left, rule) in enumerate(RULES) for d in range(len(rule) + 1) if (d < len(rule) and rule[d] in _TERMINALS) or (d == len(rule) and left == START)]


def predicted() -> Column:
    """The first column: everything the start symbol may begin with."""
    out: Column = {}
    todo = [START]
    while todo:
        left = todo.pop()
        for k, (name, rule) in enumerate(RULES):
            if name == left and (k, 0) not in out:
                out[k, 0] = (0, "")
                if rule and rule[0] not in _TERMINALS:
                    todo.append(rule[0])
    return {i: w for i, w in out.items() if i in KERNEL}


def closed(column: Column) -> Column:
    """A column with what completion and insertion add, at the least weight: the lightest item goes first, as in Dijkstra's search."""
    heap = [(w, i) for i, w in column.items()]
    heapq.heapify(heap)
    out: Column = {}
    while heap:
        weight, item = heapq.heappop(heap)
        if item in out:
            continue
        out[item] = weight
        cost, audit = weight
        awaited = _next(item)
        if awaited is None:
            left = RULES[item[0]][0]
            for k, d in _WAITING.get(left, ()):
                if (k, d + 1) not in out:
                    heapq.heappush(heap, (weight, (k, d + 1)))
        elif awaited in NAMES and (item[0], item[1] + 1) not in out:
            heapq.heappush(heap, ((cost + INSERT, audit + "I"), (item[0], item[1] + 1)))
    return {i: w for i, w in out.items() if i in _KEPT}


_KEPT = frozenset(KERNEL)


def scanned(column: Column, symbol: str) -> Column:
    """The next column's items that read a row: kept, under another role, or deleted."""
    out: Column = {}

    def put(item: Item, weight: tuple[int, str]) -> None:
        if item not in out or weight < out[item]:
            out[item] = weight

    role = symbol.lower()
    more = TRUNCATED if symbol != role else 0
    for item, (cost, audit) in column.items():
        put(item, (cost + DELETE, audit + "D"))
        awaited = _next(item)
        if symbol == GONE or awaited is None:
            continue
        after = (item[0], item[1] + 1)
        if role == awaited:
            put(after, (cost + more, audit + "K"))
        if awaited in NAMES:
            put(after, (cost + REROLE + more, audit + "R"))
    return out


def parse(symbols: str, column: Column | None = None) -> Column:
    """The column behind ``symbols``, from a column before them (the first one if None)."""
    column = closed(predicted() if column is None else column)
    for symbol in symbols:
        column = closed(scanned(column, symbol))
    return column


def least(column: Column) -> tuple[int, str]:
    """(cost, audit) of the best complete parse."""
    return min(w for i, w in column.items() if RULES[i[0]][0] == START and _next(i) is None)


@lru_cache(maxsize=50_000)
def repaired(symbols: str) -> tuple[int, str]:
    return least(parse(symbols))


def ways(symbols: str, first: bool) -> list[tuple[int, int, int, str]]:
    """(item before, item after, cost, audit) of a block, from each item that it may begin with; items by their place in ``KERNEL``."""
    out = []
    for k, item in enumerate(KERNEL):
        if not first or item in predicted():
            out += [(k, KERNEL.index(i), c, a) for i, (c, a) in parse(symbols, {item: (0, "")}).items()]
    return out


def composed(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of the blocks of a conversation, in order."""
    column = {KERNEL.index(i): w for i, w in predicted().items()}
    for block in blocks:
        after: dict[int, tuple[int, str]] = {}
        for i, j, c, a in block:
            if i in column:
                weight = (column[i][0] + c, column[i][1] + a)
                if j not in after or weight < after[j]:
                    after[j] = weight
        column = after
    return least({KERNEL[i]: w for i, w in column.items()})


def edited(rows, audit: str):
    """(role, text) of the repaired conversation; ``rows`` yields (role, text) and is read no further than the audit goes.

    What is put in, or takes another role, is what the repaired rows before it ask for.
    """
    rows, before = iter(rows), ""
    for edit in audit:
        if edit == "I":
            role, text = NAMES["a" if before == "u" else "u"], ""
        else:
            role, text = next(rows)
            if edit == "D":
                continue
            if edit == "R":
                role = NAMES["a" if before == "u" else "u"]
        before = role[:1]
        yield role, text


#: White space of the format, as a set of characters.
_GAPS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, and ``gone`` (no row is left), damaged by the checksum of conv_id and turn."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(k).cast("string"), F.lit(" ")).alias(k) for k in ("role", "text")])
    name = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = c.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), kind.alias("kind"))
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` (role, text) with initial, blank and truncated, and the digest that orders rows of the same turn and role."""
    last = F.substring(F.rtrim("text", F.lit(_GAPS)), -1, 1)
    blank = F.rtrim("text", F.lit(_GAPS)) == ""
    return rows.withColumns({"initial": F.substring("role", 1, 1), "digest": F.unhex(F.sha2("text", 256)), "blank": blank, "truncated": ~blank & ~last.isin(".", "!", "?")})


def symbol(initial: str, lost: bool, truncated: bool) -> str:
    s = GONE if lost else initial if initial in _TERMINALS and initial else "o"
    return s.upper() if truncated and not lost else s


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _hashed(pairs) -> str:
    h, n = hashlib.sha256(), 0
    for role, text in pairs:
        h.update((b"\n" if n else b"") + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        n += 1
    return h.hexdigest()


def _report(conv, rows: list[tuple]) -> tuple:
    """The result row of a conversation whose rows (turn, role, text, initial, blank, truncated, gone) lie in order."""
    rows = [r for r in rows if not r[6]]
    seen, symbols, faults = set(), [], [0, 0, 0]
    for _, role, text, initial, blank, truncated, _ in rows:
        again = (role, text) in seen
        seen.add((role, text))
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            faults[fault] += 1
        symbols.append(symbol(initial, fault in (0, 1), fault == 2))
    cost, audit = repaired("".join(symbols))
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[3] + b[3] not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    return (conv, gaps, *faults, illegal, cost, audit, _hashed(edited(((r[1], r[2]) for r in rows), audit)))


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in REPORT.split(", ")]
    types = [pa.string() if f.endswith("string") else pa.int64() for f in REPORT.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _each(batches, width: int):
    """(key, list of rows) of runs of equal first columns in sorted batches."""
    key, own = None, None
    for batch in (part for whole in batches for part in shared.parts(whole)):
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own is None or row[0] != key:
                if own is not None:
                    yield key, own
                key, own = row[0], []
            own.append(row[1:width])
    if own is not None:
        yield key, own


def short(rows: DataFrame) -> DataFrame:
    """The report of conversations that fit a worker."""

    def work(batches):
        out = []
        for conv, own in _each(batches, 8):
            out.append(_report(conv, own))
            if len(out) >= 2000:
                yield _arrow(out)
                out = []
        yield _arrow(out)

    order = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    dealt = marked(rows).repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "turn", "role", "text", "initial", "blank", "truncated", "gone").mapInArrow(shared.tidy(work), REPORT)


def long(rows: DataFrame, block: int | None = None) -> DataFrame:
    """The report of conversations of any length; nothing but their audits comes together."""
    block = block or BLOCK
    base = shared.shared_dir(rows.sparkSession)
    left = rows.filter("not gone")
    narrow = marked(left).select("conv_id", "turn", "role", "initial", "digest", "blank", "truncated")
    placed = shared.stored(ranks.ranked(narrow, ["conv_id"], [F.asc_nulls_first("turn"), "role", "digest"], "at"), "placed", base)
    # rows with their initial behind them and, of equal role and text, the first place
    same = lambda a, b: a["conv_id"].eqNullSafe(b["_conv"])
    first = placed.groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(F.min("at").alias("_first"))
    known = placed.join(first, same(placed, first) & (placed["role"] == first["_role"]) & (placed["digest"] == first["_digest"])).drop("_conv", "_role", "_digest")
    again = ~F.col("blank") & (F.col("at") > F.col("_first"))
    cut = ~again & F.col("truncated")
    lost = F.col("blank") | again
    letter = F.when(lost, F.lit(GONE)).when(F.col("initial").isin("s", "u", "a"), F.when(cut, F.upper("initial")).otherwise(F.col("initial"))).otherwise(F.when(cut, F.lit("O")).otherwise(F.lit("o")))
    # the block of a row, and once more that of the row before it, so that each block sees the pair that it begins
    own = F.struct((F.floor((F.col("at") - 1) / block)).alias("block"), F.lit(True).alias("own"))
    next_ = F.struct((F.floor(F.col("at") / block)).alias("block"), F.lit(False).alias("own"))
    each = known.select("conv_id", "turn", "initial", "at", "blank", again.alias("again"), cut.alias("cut"), letter.alias("letter"), F.inline(F.when(F.col("at") % block == 0, F.array(own, next_)).otherwise(F.array(own))))
    mine = F.col("own")
    row = F.struct("at", "initial", "letter", "own")
    blocks = each.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.count_if(mine & F.col("blank")).alias("blank"), F.count_if(mine & F.col("again")).alias("duplicate"), F.count_if(mine & F.col("cut")).alias("truncated"),
    )
    symbols = F.array_join(F.transform(F.filter("rows", lambda r: r.own), lambda r: r.letter), "")
    pairs = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("rows") - 1, F.lit(1))), lambda k: F.concat(F.coalesce(F.get("rows", k - 1).initial, F.lit("")), F.coalesce(F.get("rows", k).initial, F.lit("")))), lambda p: ~p.isin(*LEGAL)))
    illegal = F.when(F.size("rows") > 1, pairs).otherwise(F.lit(0)).cast("long")
    # a block that only the row before begins has nothing of its own: the conversation ends there
    blocks = blocks.select("conv_id", "block", symbols.alias("symbols"), "blank", "duplicate", "truncated", illegal.alias("illegal")).filter("symbols <> ''")

    def parsed(batches):
        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in (part for whole in batches for part in shared.parts(whole, 50)):
            found = [[dict(zip(("i", "j", "cost", "audit"), w, strict=True)) for w in ways(s, b == 0)] for b, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in (0, 1, 3, 4, 5, 6)], pa.array(found, kind)], names=["conv_id", "block", "blank", "duplicate", "truncated", "illegal", "ways"])

    # blocks of a hot conversation are dealt like any others
    dealt = blocks.repartition("conv_id", "block")
    parts = shared.stored(dealt.mapInArrow(shared.tidy(parsed), "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, ways array<struct<i:int,j:int,cost:bigint,audit:string>>"), "parts", base)

    def joined(batches):
        ids, costs, audits = [], [], []
        for conv, own in _each(batches, 3):
            cost, audit = composed([[(w["i"], w["j"], w["cost"], w["audit"]) for w in ways_] for _, ways_ in own])
            ids.append(conv)
            costs.append(cost)
            audits.append(audit)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string())], names=["conv_id", "cost", "audit"])

    audits = parts.select("conv_id", "block", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(shared.tidy(joined), "conv_id long, cost long, audit string")
    audits = shared.stored(audits, "audits", base)
    sums = parts.groupBy("conv_id").agg(*[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated", "illegal")])
    spread = placed.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps")).select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))

    # the audit comes first, then the rows in order, and the stream hashes what it reads
    head = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    body = marked(left).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    stream = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.asc_nulls_first("turn"), "role", "digest")

    def digests(batches):
        rows = (r for whole in batches for part in shared.parts(whole) for r in zip(*[c.to_pylist() for c in part.columns], strict=True))
        out, ahead = [], next(rows, None)
        while ahead is not None:
            conv, _, _, audit = ahead
            ahead = None

            def own(conv=conv):
                nonlocal ahead
                for r in rows:
                    if r[1] == 0:
                        ahead = r
                        return
                    yield r[2], r[3]

            mine = own()
            out.append((conv, _hashed(edited(mine, audit))))
            for _ in mine:  # up to the next conversation
                pass
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.string())], names=["conv_id", "repaired_sha256"])

    hashes = stream.select("conv_id", "kind", "role", "text").mapInArrow(shared.tidy(digests), "conv_id long, repaired_sha256 string")
    # a conversation whose rows are all gone has none of these
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("_one"))
    out = every
    for k, df in enumerate((spread, sums, audits, hashes)):
        df = df.withColumnRenamed("conv_id", f"_c{k}")
        out = out.join(df, out["conv_id"].eqNullSafe(df[f"_c{k}"]), "left").drop(f"_c{k}")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = out.fillna(0, numbers).fillna({"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()})
    return out.select("conv_id", *numbers, "audit", "repaired_sha256")


def repair(rows: DataFrame, long_rows: int | None = None, long_bytes: int | None = None, block: int | None = None) -> DataFrame:
    """The report (``REPORT``) of the conversations of ``rows`` (conv_id, turn, role, text, gone), one row each.

    ``gone`` marks rows that only say that their conversation exists.
    """
    long_rows, long_bytes = LONG_ROWS if long_rows is None else long_rows, LONG_BYTES if long_bytes is None else long_bytes
    spark = rows.sparkSession
    shared.ship(spark)
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("size"))
    big = shared.stored(sizes.filter((F.col("n") > long_rows) | (F.col("size") > long_bytes)).select(F.col("conv_id").alias("_big")), "long")
    if big.isEmpty():
        return short(rows)
    which = rows["conv_id"].eqNullSafe(big["_big"])
    return short(rows.join(big, which, "left_anti")).unionByName(long(rows.join(big, which, "left_semi"), block))


def _sql() -> str:
    """SQL for the report: a checksum's table, faults, and the least ways to the four places of the grammar, row by row.

    A way is a text of its cost, padded, and its audit, so the least text is the least pair.
    """

    def add(way: str, cost: str, edit: str) -> str:
        return f"printf('%09d', substr({way}, 1, 9)::INT + {cost}) || substr({way}, 10) || '{edit}'"

    def when(test: str, way: str) -> str:
        return f"CASE WHEN {test} THEN {way} END"

    def columns(places: dict[str, str]) -> str:
        # z: nothing yet; l: behind a system message; b: behind a user; c: behind an assistant. What is put in comes last.
        b = f"least({places['b']}, {add(places['z'], '3', 'I')}, {add(places['l'], '3', 'I')}, {add(places['c'], '3', 'I')})"
        return f"{places['z']} AS z, {places['l']} AS l, {b} AS b, {places['c']} AS c0"

    stay = "sym <> 'x'"
    kept = lambda role, way: when(f"lower(sym) = '{role}'", add(way, "t", "K"))
    other = lambda way: when(stay, add(way, "3 + t", "R"))
    step = {
        "z": add("z", "4", "D"),
        "l": f"least({add('l', '4', 'D')}, {kept('s', 'z')})",
        "b": f"least({add('b', '4', 'D')}, {', '.join(f'{kept("u", w)}, {other(w)}' for w in 'zlc')})",
        "c": f"least({add('c', '4', 'D')}, {kept('a', 'b')}, {other('b')})",
    }
    shut = "z, l, b, least(c0, " + add("b", "3", "I") + ") AS c"
    return f"""
WITH RECURSIVE k AS (SELECT range::BIGINT AS i, 0 AS k, range::BIGINT AS v FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM k WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM k WHERE k = 8),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS h FROM conversations),
kinds AS (SELECT raw.*, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT),
  lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM raw, tab),
rows_ AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
seq AS (SELECT conv_id AS conv, turn, role, text, row_number() OVER w AS pos,
  NOT regexp_matches(text, '[^ \t\n\v\f\r]') AS blank, regexp_extract(text, '(?s)([^ \t\n\v\f\r])[ \t\n\v\f\r]*$', 1) AS last, lag(role) OVER w AS prior
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
turns AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) AS nth FROM seq),
marks AS (SELECT *, CASE WHEN blank THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM turns),
syms AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS sym, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS t FROM marks),
stats AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND (prior[1] || role[1]) NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n FROM syms GROUP BY conv),
first AS (SELECT conv, n, 0::BIGINT AS pos, '000000000' AS z, NULL::VARCHAR AS l, NULL::VARCHAR AS b, NULL::VARCHAR AS c0 FROM stats),
opened AS (SELECT conv, n, pos, z, l, {add("z", "3", "I")} AS b, c0 FROM first),
way AS (SELECT conv, n, pos, {shut} FROM opened UNION ALL
  SELECT conv, n, pos, {shut} FROM (SELECT way.conv, n, syms.pos, {columns(step)} FROM way JOIN syms ON syms.conv IS NOT DISTINCT FROM way.conv AND syms.pos = way.pos + 1)),
best AS (SELECT conv, least(z, c) AS w FROM way WHERE pos = n),
done AS (SELECT conv, substr(w, 1, 9)::BIGINT AS cost, substr(w, 10) AS audit FROM best),
edits AS (SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS p FROM done),
steps AS (SELECT conv, p, audit[p] AS e, len(replace(audit[1:p], 'I', '')) AS pos, len(replace(audit[1:p], 'D', '')) AS nth FROM edits),
out AS (SELECT steps.conv, p, steps.nth, e, role, text FROM steps LEFT JOIN syms ON syms.conv IS NOT DISTINCT FROM steps.conv AND syms.pos = steps.pos AND e <> 'I' WHERE e <> 'D'),
lead_ AS (SELECT *, max(CASE WHEN nth = 1 AND e = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv) AS s FROM out),
text_ AS (SELECT conv, string_agg(CASE WHEN e = 'K' THEN role WHEN (nth - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS text FROM lead_ GROUP BY conv),
every_ AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(text_.text, '')) AS repaired_sha256
FROM every_ LEFT JOIN stats ON stats.conv IS NOT DISTINCT FROM conv_id LEFT JOIN done ON done.conv IS NOT DISTINCT FROM conv_id LEFT JOIN text_ ON text_.conv IS NOT DISTINCT FROM conv_id
"""


SQL = _sql()


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
