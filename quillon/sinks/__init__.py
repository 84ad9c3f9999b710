"""Reports of an audit: JSON rows, tab-separated lines, and the exit code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import ranks


def as_json(df: DataFrame, by: str = "pair_id") -> DataFrame:
    """(by, json): each row as a JSON object; numbers stay numbers, nulls are kept."""
    return df.select(by, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def nested_json(tables: dict[str, DataFrame], by: str = "pair_id") -> DataFrame:
    """(by, json): one object for each pair, with its summary and a list for every other table."""
    out = tables["summary"].select(by, F.struct(*tables["summary"].columns).alias("summary"))
    names = []
    for name, df in tables.items():
        if name == "summary":
            continue
        rows = df.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias(name))
        out = out.join(rows, by, "left")
        names.append(name)
    return out.select(by, F.to_json(F.struct("summary", *names), {"ignoreNullFields": "false"}).alias("json"))


def _line(*parts):
    return F.concat_ws("\t", *[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _num(c: str):
    return F.coalesce(T.clean_number(F.col(c).cast("double")), F.lit("None"))


def _ratio(c: str):
    # four places without the zeros at the end, but one
    return F.regexp_replace(F.format_string("%.4f", F.bround(F.col(c), 4)), r"(\.\d+?)0+$", "$1")


# The headings of the sections.
HEADINGS = {
    2: "LSI\tgroup\tmedian\tbefore\tafter\tstatus",
    3: "DEPTH\tgroup\ttarget\tbefore\tafter\tstatus\tsynchronized",
    4: "MINIMUM\tgroup\tminimum\tbefore\tafter\tstatus",
    5: "IRRELEVANT\tform\ttarget\tbefore\tafter\tstatus",
    6: "WIDTH\tword\tbefore\tafter\tstatus",
}


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(pair_id, section_ord, row_ord, line) of the tab-separated report; write it ordered by these."""
    s, parts = tables["summary"], []
    show = lambda a, b, f=lambda c: F.col(c).cast("string"): F.concat(f(a), F.lit("->"), f(b))
    field = lambda k, v: F.concat(F.lit(k + "="), v)
    text = lambda c: F.col(c).cast("string")
    line = _line(
        "SUMMARY", field("lsi_groups", text("raw_groups")), field("lsi_over", text("lsi_over")), field("breadth_over", text("breadth_over")),
        field("covered", show("raw_covered_before", "raw_covered_after")), field("width", show("raw_width_before", "raw_width_after", _ratio)), field("depth", show("raw_depth_before", "raw_depth_after", _ratio)),
        field("negative_groups", text("negative_groups")), field("negative_above", text("negative_above")), field("minimum_below", text("minimum_below")), field("irrelevant_above", text("irrelevant_above")),
        field("width_words", F.concat(show("width_covered_before", "width_covered_after"), F.lit("/"), text("width_words"))), field("introduced_flags", text("introduced_token_flags")), field("frame_flags", text("introduced_frame_flags")),
        field("yo", show("source_yo", "edited_yo")), field("facts_missing", text("missing_fact_tokens")), field("facts_added", text("added_fact_tokens")), field("warnings", text("warnings")),
    )
    row = lambda df, section, order, line: parts.append(df.select("pair_id", F.lit(section).alias("section_ord"), order.cast("long").alias("row_ord"), line.alias("line")))
    row(s, 0, F.lit(0), line)
    if "filtered_groups" in s.columns:
        row(s, 1, F.lit(0), _line("FILTERED", field("groups", text("filtered_groups")), field("covered", show("filtered_covered_before", "filtered_covered_after")), field("width", show("filtered_width_before", "filtered_width_after", _ratio)), field("depth", show("filtered_depth_before", "filtered_depth_after", _ratio))))
    for k, heading in HEADINGS.items():
        row(s, k, F.lit(-1), F.lit(heading))
    changed = F.col("before") != F.col("after")
    tail = [text("before"), text("after"), F.col("status")]
    row(tables["groups"].filter(changed | F.col("status").isin("over", "breadth-over")), 2, F.col("breadth_rank"), _line("LSI", F.col("word"), _num("median"), *tail))
    if "depth" in tables:
        row(tables["depth"], 3, F.col("row_ix"), _line("DEPTH", F.col("word"), _num("target"), *tail, text("synchronized")))
        row(tables["minimum"].filter(changed | (F.col("status") == "below")), 4, F.col("row_ix"), _line("MINIMUM", F.col("word"), _num("minimum"), *tail))
    if "irrelevant" in tables:
        row(tables["irrelevant"].filter("before > 0 or after > 0"), 5, F.col("row_ix"), _line("IRRELEVANT", F.col("form"), text("target"), *tail))
    if "width" in tables:
        row(tables["width"].filter(changed), 6, F.col("row_ix"), _line("WIDTH", F.col("word"), *tail))
    for k, side in ((7, "missing"), (8, "added")):
        f = tables["facts"].select("pair_id", F.posexplode(side).alias("row_ix", "token"))
        row(f, k, F.col("row_ix"), _line("FACT", side, F.col("token")))
    row(tables["warnings"], 9, F.col("kind_ord").cast("long") * 1_000_000_000 + F.col("row_ord"), _line("WARNING", F.col("warning")))
    for k, name in ((10, "tokens"), (11, "bigrams"), (12, "trigrams")):
        from pyspark.sql import Window as W

        place = F.row_number().over(W.partitionBy("pair_id").orderBy(F.desc("added"), F.desc("after"), F.asc("pattern")))
        row(tables[name].withColumn("place", place), k, F.col("place"), _line("INTRODUCED", name, F.col("pattern"), text("before"), text("after"), F.concat(F.lit("+"), text("added"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exit_codes(summary: DataFrame, strict: bool = True) -> DataFrame:
    """(pair_id, code): 0, or 1 where a strict audit fails; errors (2) are raised instead."""
    return summary.select("pair_id", F.when(F.lit(strict) & F.col("failed"), 1).otherwise(0).alias("code"))


# The kinds of errors, and the exit code of each.
ERRORS = {"missing_api_key": 2, "http_error": 1, "network_error": 1, "invalid_json": 1}


def answer_json(answers: DataFrame, service: str = "The service", keep: list[str] | None = None) -> DataFrame:
    """(keep, json, code) of normalised answers: the answer with its sources and meta data, or an error record.

    Columns that tell errors apart, where they are given: has_key (false: no request was made), network_error (why none
    came back), status (400 or more: refused; ``json`` is its body). Else a text that isn't a JSON object is malformed.
    Bodies of refused requests are kept as text.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in answers.columns else F.lit(None).cast(kind)
    key, network, status, body = given("has_key", "boolean"), given("network_error", "string"), given("status", "int"), given("json", "string")
    kind = F.when(F.coalesce(~key, F.lit(False)), "missing_api_key").when(network.isNotNull(), "network_error").when(status >= 400, "http_error").when(~F.col("ok"), "invalid_json")
    meta = F.struct("id", "model", "created", "usage")
    query = [given("query", "string").alias("query")] if "query" in answers.columns else []
    good = F.to_json(F.struct(F.lit(True).alias("ok"), *query, "answer", "sources", meta.alias("meta")), {"ignoreNullFields": "false"})
    message = (
        F.when(F.col("_kind") == "missing_api_key", "the key isn't set; no request was made").when(F.col("_kind") == "network_error", network)
        .when(F.col("_kind") == "http_error", F.concat(F.lit(f"{service} returned HTTP "), status.cast("string"), F.lit("."))).otherwise("the response is not a JSON object")
    )
    refused = F.col("_kind") == "http_error"
    error = F.struct(F.col("_kind").alias("type"), message.alias("message"), F.when(refused, status).alias("status"), F.when(refused, body).alias("response"))
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), error.alias("error")))
    code = F.lit(0)
    for k, c in ERRORS.items():
        code = F.when(F.col("_kind") == k, c).otherwise(code)
    return answers.withColumn("_kind", kind).select(*(keep or []), F.when(F.col("_kind").isNull(), good).otherwise(bad).alias("json"), code.alias("code"))


def brief(sections: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> DataFrame:
    """(section_ord, row_ord, line) of a Markdown brief: a heading and a table for each section, in the order given.

    Cells are text with bars escaped and line ends as spaces; null is a dash. ``order``: columns by which a section's rows are sorted.
    """
    parts = []
    for k, (title, df) in enumerate(sections.items(), 1):
        spark = df.sparkSession
        head = ["", f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines = spark.createDataFrame([(k, n, x) for n, x in enumerate(head, -len(head))], "section_ord int, row_ord long, line string")
        cell = lambda c: F.coalesce(F.regexp_replace(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " "), F.lit("–"))
        by = (order or {}).get(title, df.columns)
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
        placed = ranks.ranked(df, [], list(by), "__place")
        parts += [lines, placed.select(F.lit(k).alias("section_ord"), (F.col("__place") - 1).alias("row_ord"), row.alias("line"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
