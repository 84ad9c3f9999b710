"""Target tables from workbook cells: sheet and header resolution, depth, group and phrase tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.sources.texts import first_wins

# Header names of the tables, in order of preference, and hints in sheet names.
DEPTH = {"word": ["слово"], "forms": ["словоформы", "словоформа"]}
DEPTH_OPTIONAL = {"repeats": ["повторы", "текст у вас"], "minimum": ["минимум по рекомендациям"], "maximum": ["максимум по рекомендациям"], "delta": ["добавить/удалить"]}
GROUPS = {"word": ["слова", "слово"], "median": ["медиана"], "link": ["связь слов с другим листом"]}
GROUPS_OPTIONAL = {"analyzer_current": ["текст у вас", "ваша страница", "ваша страница (повторы)"]}
PHRASES = {"phrase": ["n-граммы", "n-граммы (включая все словоформы)"], "median": ["медианное вхождение"]}
PHRASES_OPTIONAL = {"analyzer_current": ["на нашем сайте"]}
HINTS = {"depth": "глубин", "summary": "сводим форм", "forms": "все форм", "phrases": "n-грамм"}


def headers(cells: DataFrame) -> DataFrame:
    """Cells of each sheet's first row that has a non-blank cell, with the normalised text as header."""
    shown = cells.withColumn("text", T.cell("value", "is_num"))
    first = shown.filter(T.strip("text") != "").groupBy("file", "sheet_ix").agg(F.min("row_ix").alias("header_ix"))
    head = shown.join(first, ["file", "sheet_ix"]).filter("row_ix = header_ix")
    return head.select("file", "sheet_ix", "sheet", "header_ix", "col_ix", T.normalize_header("text").alias("header"))


def resolve(head: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """(file, sheet_ix, sheet, header_ix, field, col_ix): the column of each field; an earlier alias wins, then an earlier column."""
    aliases = [(f, k, " ".join(a.casefold().replace("ё", "е").split())) for f, names in fields.items() for k, a in enumerate(names)]
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("alias_ord"), F.lit(a).alias("alias")) for f, k, a in aliases])
    matches = head.select("*", F.inline(listed)).filter((F.col("header") == F.col("alias")) | F.startswith("header", F.concat("alias", F.lit(" ("))))
    return matches.groupBy("file", "sheet_ix", "sheet", "header_ix", "field").agg(F.min_by("col_ix", F.struct("alias_ord", "col_ix")).alias("col_ix"))


def detect(cells: DataFrame, required: dict[str, list[str]], hint: str | None = None, optional: dict[str, list[str]] | None = None) -> DataFrame:
    """(file, sheet_ix, header_ix, columns map) of the sheet that has all required fields.

    Of several, one whose name holds the hint is taken, else the first.
    """
    found = resolve(headers(cells), {**required, **(optional or {})})
    maps = found.groupBy("file", "sheet_ix", "sheet", "header_ix").agg(F.map_from_entries(F.collect_list(F.struct("field", "col_ix"))).alias("columns"))
    whole = F.lit(True)
    for f in required:
        whole = whole & F.col("columns")[f].isNotNull()
    score = F.when(F.contains(T.normalize("sheet"), F.lit(hint or "")), 1).otherwise(0) if hint else F.lit(0)
    return first_wins(maps.filter(whole).withColumn("score", -score), ["file"], ["score", "sheet_ix"]).select("file", "sheet_ix", "header_ix", "columns")


def table(cells: DataFrame, sheets: DataFrame, fields: list[str]) -> DataFrame:
    """(file, row_ix, field...) below the header of each detected sheet; missing cells are ''."""
    rows = cells.withColumn("text", T.cell("value", "is_num")).withColumn("raw", F.coalesce("value", F.lit(""))).join(sheets, ["file", "sheet_ix"]).filter("row_ix > header_ix")
    pick = lambda f, c: F.coalesce(F.max(F.when(F.col("col_ix") == F.col("columns")[f], F.col(c))), F.lit(""))
    return rows.groupBy("file", "row_ix").agg(*[pick(f, "text").alias(f) for f in fields], *[pick(f, "raw").alias(f"{f}_raw") for f in fields])


def _forms(*arrays):
    out = arrays[0]
    for a in arrays[1:]:
        out = F.array_union(out, a)
    normal = F.transform(out, lambda f: T.strip(T.normalize(f)))
    return F.array_sort(F.array_distinct(F.filter(normal, lambda f: f != "")))


def _require(found: DataFrame, cells: DataFrame, what: str) -> None:
    lost = cells.select("file").distinct().join(found.select("file"), "file", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no {what} table in {lost[0].file}")


def depth_table(cells: DataFrame) -> DataFrame:
    """(file, row_ix, word, forms, repeats, minimum, maximum, delta); a workbook needs one of the four numbers."""
    sheets = detect(cells, DEPTH, HINTS["depth"], DEPTH_OPTIONAL)
    _require(sheets, cells, "depth")
    any_number = F.lit(False)
    for f in DEPTH_OPTIONAL:
        any_number = any_number | F.col("columns")[f].isNotNull()
    _require(sheets.filter(any_number), cells, "numeric depth")
    rows = table(cells, sheets, [*DEPTH, *DEPTH_OPTIONAL]).withColumn("word", T.strip("word")).filter("word <> ''")
    return rows.select("file", "row_ix", "word", _forms(T.split_forms("forms"), F.array("word")).alias("forms"), *[T.number(f"{f}_raw").alias(f) for f in DEPTH_OPTIONAL])


def forms_by_link(rows: DataFrame) -> DataFrame:
    """(file, link, linked): the words of each link; words without a link give none."""
    rows = rows.select("file", T.strip("word").alias("word"), T.relation_key("link_raw").alias("link")).filter("word <> '' and link <> ''")
    return rows.groupBy("file", "link").agg(F.collect_set("word").alias("linked"))


def ranked(rows: DataFrame, limit: int, keys: list[str], word: str = "word", order: str = "row_ix") -> DataFrame:
    """The first ``limit`` different words in order, with their breadth_rank."""
    rows = rows.withColumn("_key", T.normalize_header(word))
    kept = first_wins(rows, [*keys, "_key"], [order])
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return kept.withColumn("breadth_rank", rank).filter(F.col("breadth_rank") <= limit)


def supplemented(groups: DataFrame, depth: DataFrame, keys: list[str]) -> DataFrame:
    """Groups (keys, _key, forms) whose forms take in those of the last depth row of the same word."""
    last = depth.withColumn("_key", T.normalize_header("word")).groupBy(*keys, "_key").agg(F.max_by("forms", "row_ix").alias("_more"))
    out = groups.join(last, [*keys, "_key"], "left")
    return out.withColumn("forms", _forms("forms", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def group_table(cells: DataFrame, depth: DataFrame | None = None, limit: int = 150) -> DataFrame:
    """(file, breadth_rank, word, forms, median, analyzer_current) of the first ``limit`` groups."""
    summary = detect(cells, GROUPS, HINTS["summary"], GROUPS_OPTIONAL)
    _require(summary, cells, "group")
    linked = forms_by_link(table(cells, detect(cells, GROUPS, HINTS["forms"]), list(GROUPS)))
    rows = table(cells, summary, [*GROUPS, *GROUPS_OPTIONAL]).withColumn("word", T.strip("word")).filter("word <> ''")
    top = ranked(rows, limit, ["file"]).withColumn("link", T.relation_key("link_raw")).join(linked, ["file", "link"], "left")
    top = top.withColumn("forms", _forms(F.coalesce("linked", F.array().cast("array<string>")), F.array("word")))
    if depth is not None:
        top = supplemented(top, depth, ["file"])
    return top.select("file", "breadth_rank", "word", "forms", T.number("median_raw").alias("median"), T.number("analyzer_current_raw").alias("analyzer_current"))


def phrase_table(cells: DataFrame) -> DataFrame:
    sheets = detect(cells, PHRASES, HINTS["phrases"], PHRASES_OPTIONAL)
    _require(sheets, cells, "phrase")
    rows = table(cells, sheets, [*PHRASES, *PHRASES_OPTIONAL])
    out = rows.select("file", "row_ix", T.strip("phrase").alias("phrase"), T.number("median_raw").alias("median"), T.number("analyzer_current_raw").alias("analyzer_current"))
    return out.filter("phrase <> '' and median is not null")
