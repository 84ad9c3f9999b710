"""Text files of uncertain charset, word lists and saved web answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T

ANSWER = "id string, model string, created string, ok boolean, query string, choices array<struct<message:struct<content:string>>>, search_results array<string>, citations array<string>, usage map<string,string>"
RESULT = "title string, url string, date string, last_updated string, snippet string, source string"


def _cyrillic_table() -> str:
    """The upper half of the Cyrillic code page."""
    return bytes(range(128, 256)).decode("cp1251", "replace")


def decoded(content):
    """Text of bytes: UTF-8 (a leading byte order mark is taken off), else the Cyrillic code page, natively.

    Bytes that aren't UTF-8 are read one to one as Latin-1 and then mapped; the one byte that the
    code page lacks (152) gives null.
    """
    c = F.col(content) if isinstance(content, str) else content
    latin = F.decode(c, "ISO-8859-1")
    other = F.translate(latin, "".join(map(chr, range(128, 256))), _cyrillic_table())
    plain = F.regexp_replace(F.decode(F.when(F.is_valid_utf8(c.cast("string")), c), "UTF-8"), "^﻿", "")
    return F.when(F.is_valid_utf8(c.cast("string")), plain).when(~F.contains(latin, F.lit(chr(152))), other)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files; Spark lists no files without bytes."""
    return spark.read.format("binaryFile").load(path).select("path", decoded("content").alias("text"))


def first_wins(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return items.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def word_list(lists: DataFrame, scope: str = "scope", text: str = "text") -> DataFrame:
    """(scope, row_ix, word, key): items of delimited lists; of equal items the first stays."""
    items = lists.select(scope, F.posexplode(T.split_forms(text)).alias("row_ix", "word"))
    items = items.withColumn("key", T.normalize_header("word")).filter("key <> ''")
    return first_wins(items, [scope, "key"], ["row_ix"])


# The sentence that reports an unwanted form, and the heading of such lists.
REPORTED = r"(?iu)нерелевантное слово(?U)\s*\(точная словоформа\)\s+(.+?)\s+у вас повторяется\s+(\d+)\s+раз"
HEADING = "нерелевантные слова"
EXPLICIT = r"(?U)^(.+?)\s*(?:->|=>)\s*(\d+)$"


def unwanted_forms(lists: DataFrame, scope: str = "scope", text: str = "text") -> DataFrame:
    """(scope, row_ix, form, reported_current, target): sentences first, then the items of other lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    forms, counts = F.regexp_extract_all(t, F.lit(REPORTED), F.lit(1)), F.regexp_extract_all(t, F.lit(REPORTED), F.lit(2))
    said = lists.select(scope, F.posexplode(F.arrays_zip(forms.alias("f"), counts.alias("c"))).alias("pos", "x"))
    said = said.select(scope, F.lit(1).alias("pass"), "pos", T.strip("x.f").alias("form"), F.col("x.c").cast("int").alias("reported_current"), F.lit(0).alias("target"))
    lines = F.filter(F.split(t, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), lambda x: (T.normalize_header(x) != "") & (T.normalize_header(x) != HEADING) & ~F.rlike(x, F.lit(REPORTED)))
    rest = lists.select(scope, F.posexplode(T.split_forms(F.array_join(lines, "\n"))).alias("pos", "item"))
    explicit = F.rlike("item", F.lit(EXPLICIT))
    form = F.when(explicit, T.strip(F.regexp_extract("item", EXPLICIT, 1))).otherwise(F.col("item"))
    target = F.when(explicit, F.regexp_extract("item", EXPLICIT, 2).try_cast("int")).otherwise(F.lit(0))
    rest = rest.select(scope, F.lit(2).alias("pass"), "pos", form.alias("form"), F.lit(None).cast("int").alias("reported_current"), target.alias("target"))
    both = said.unionByName(rest).withColumn("key", T.normalize_header("form")).filter("key <> ''")
    kept = first_wins(both, [scope, "key"], ["pass", "pos"])
    return kept.select(scope, (F.col("pass") * 1_000_000 + F.col("pos")).alias("row_ix"), "form", "reported_current", "target")


def answers(raw: DataFrame, json: str = "json") -> DataFrame:
    """``raw`` with the answer's first text, its sources (one per URL) and its meta data.

    Sources are the search results that are objects with a URL, in order, then cited URLs that
    are not among them; of equal URLs the first stays. A text that isn't a JSON object gives ok = false.
    """
    a = F.from_json(json, ANSWER)
    rows = raw.withColumn("_a", a)
    object_ = lambda x: F.from_json(x, RESULT)
    typed = lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v.url")
    results = F.filter(F.transform(F.filter(F.coalesce("_a.search_results", F.array().cast("array<string>")), lambda x: F.rlike(x, F.lit(r"^\s*\{")) & typed(x).isNotNull()), object_), lambda x: F.coalesce(x.url, F.lit("")) != "")
    empty = F.lit(None).cast("string")
    cited = F.transform(F.filter(F.coalesce("_a.citations", F.array().cast("array<string>")), lambda u: (F.coalesce(u, F.lit("")) != "") & ~F.rlike(u, F.lit(r"^(-?\d+(\.\d+)?|true|false|\{.*|\[.*)$"))), lambda u: F.struct(empty.alias("title"), u.alias("url"), empty.alias("date"), empty.alias("last_updated"), empty.alias("snippet"), F.lit("citation").alias("source")))
    rows = rows.withColumn("_s", F.concat(results, cited))
    urls = F.transform("_s", lambda s: s.url)
    sources = F.filter("_s", lambda s, i: F.array_position(urls, s.url) == i + 1)
    ok = F.rlike(F.coalesce(F.col(json), F.lit("")), F.lit(r"^\s*\{")) & F.col("_a").isNotNull()
    return rows.select(*raw.columns, ok.alias("ok"), F.get("_a.choices", F.lit(0)).message.content.alias("answer"), sources.alias("sources"), F.col("_a.id").alias("id"), F.col("_a.model").alias("model"), F.col("_a.created").alias("created"), F.col("_a.usage").alias("usage"))
