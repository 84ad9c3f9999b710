"""One audit from the command line: ``python -m quillon --source a.txt --text b.txt --lsi groups.xlsx``.

Ends with 0, with 1 if ``--strict`` is given and a binding limit is broken, with 2 on an error.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import sinks
from quillon.operators import audit, targets
from quillon.sources import texts, xlsx

SCOPE = "scope"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quillon", description="Audit an edited text against its source and vocabulary targets.")
    for name, needed in (("source", True), ("text", True), ("lsi", True), ("depth", False), ("phrases", False), ("irrelevant", False), ("width-words", False), ("relevant-groups", False), ("json-output", False)):
        p.add_argument(f"--{name}", required=needed, type=Path)
    p.add_argument("--breadth-limit", type=int, default=150)
    p.add_argument("--json", action="store_true")
    p.add_argument("--strict", action="store_true")
    return p.parse_args(argv)


def _cells(spark: SparkSession, path: Path) -> DataFrame:
    files = spark.read.format("binaryFile").load(str(path)).select("path", "content")
    return xlsx.from_binary(files)


def _scoped(df: DataFrame) -> DataFrame:
    return df.drop("file").withColumn(SCOPE, F.lit("all"))


def tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The result tables of the audit that ``args`` ask for."""
    config = audit.AuditConfig(breadth_limit=args.breadth_limit)
    read = lambda p: texts.read_texts(spark, str(p)).select(F.lit("all").alias(SCOPE), "text")
    pairs = read(args.source).withColumnRenamed("text", "source_text").join(read(args.text).withColumnRenamed("text", "edited_text"), SCOPE).withColumn("pair_id", F.lit(1).cast("long"))
    depth = None if args.depth is None else targets.depth_table(_cells(spark, args.depth)).withColumn("file", F.lit("f"))
    groups = _scoped(targets.group_table(_cells(spark, args.lsi).withColumn("file", F.lit("f")), depth, config.breadth_limit))
    phrases = None if args.phrases is None else _scoped(targets.phrase_table(_cells(spark, args.phrases)))
    irrelevant = None if args.irrelevant is None else texts.unwanted_forms(read(args.irrelevant))
    width = None if args.width_words is None else texts.word_list(read(args.width_words))
    relevant = None if args.relevant_groups is None else texts.word_list(read(args.relevant_groups))
    if pairs.filter("source_text is not null and edited_text is not null").count() != 1:
        raise ValueError("the charset of a text can't be told")
    return audit.audit(pairs, groups, None if depth is None else _scoped(depth), phrases, irrelevant, width, relevant, config=config)


# The names of the result's lists and of the summary's fields, with the columns behind them.
LISTS = {"lsi_groups": "groups", "negative_groups": "depth", "minimum_groups": "minimum", "phrases_present": "phrases", "irrelevant_groups": "irrelevant", "width_word_groups": "width"}
FIELDS = {
    "lsi_groups": "raw_groups", "median_groups": "raw_median_groups", "lsi_over": "lsi_over", "breadth_over": "breadth_over", "covered_before": "raw_covered_before", "covered_after": "raw_covered_after",
    "raw_width_before": "raw_width_before", "raw_width_after": "raw_width_after", "raw_depth_before": "raw_depth_before", "raw_depth_after": "raw_depth_after",
    "filtered_groups": "filtered_groups", "filtered_covered_before": "filtered_covered_before", "filtered_covered_after": "filtered_covered_after", "filtered_width_before": "filtered_width_before",
    "filtered_width_after": "filtered_width_after", "filtered_depth_before": "filtered_depth_before", "filtered_depth_after": "filtered_depth_after", "negative_groups": "negative_groups",
    "negative_above": "negative_above", "minimum_groups": "minimum_groups", "minimum_below": "minimum_below", "irrelevant_groups": "irrelevant_groups", "irrelevant_above": "irrelevant_above",
    "width_words": "width_words", "width_covered_before": "width_covered_before", "width_covered_after": "width_covered_after", "introduced_token_flags": "introduced_token_flags",
    "introduced_frame_flags": "introduced_frame_flags", "source_yo": "source_yo", "edited_yo": "edited_yo", "missing_fact_tokens": "missing_fact_tokens", "added_fact_tokens": "added_fact_tokens", "warnings": "warnings",
}
INNER = ("pair_id", "scope", "row_ix", "key", "free")


def _plain(v):
    return int(v) if isinstance(v, float) and v.is_integer() else v


def result(out: dict[str, DataFrame], args: argparse.Namespace) -> dict:
    """One pair's result as a nested value; a single audit is small, so its rows come to the driver."""
    s = out["summary"].first().asDict()
    summary = {k: round(s[c], 4) if isinstance(s.get(c), float) else s.get(c) for k, c in FIELDS.items()} | {"breadth_limit": args.breadth_limit}
    rows = lambda name, order: [{k: _plain(v) for k, v in r.asDict().items() if k not in INNER} for r in out[name].orderBy(order).collect()] if name in out else []
    lists = {k: rows(name, "breadth_rank" if name == "groups" else "row_ix") for k, name in LISTS.items()}
    patterns = {n: [{k: v for k, v in r.asDict().items() if k != "pair_id"} for r in out[n].orderBy(F.desc("added"), F.desc("after"), "pattern").collect()] for n in ("tokens", "bigrams", "trigrams")}
    facts = out["facts"].first()
    paths = {k: str(v) if (v := getattr(args, k)) else None for k in ("source", "text", "lsi", "depth", "phrases", "irrelevant", "width_words", "relevant_groups")}
    said = [r.warning for r in out["warnings"].orderBy("kind_ord", "row_ord", "warning").collect()]
    return paths | {"summary": summary} | lists | {"introduced_patterns": patterns, "fact_tokens": {"missing": facts.missing, "added": facts.added}, "warnings": said}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    own = spark is None
    spark = spark or SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    try:
        out = tables(spark, args)
        out = {k: v.cache() for k, v in out.items()}
        if args.json or args.json_output:
            text = json.dumps(result(out, args), ensure_ascii=False, indent=2)
            if args.json_output:
                args.json_output.write_text(text, encoding="utf-8")
        if args.json:
            print(text)
        else:
            for r in sinks.report(out).orderBy("section_ord", "row_ord", "line").collect():
                print(r.line)
        return sinks.exit_codes(out["summary"], args.strict).first().code
    except Exception as error:  # one line instead of a trace, as a command line tool should
        print(f"ERROR\t{str(error).splitlines()[0]}", file=sys.stderr)
        return 2
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
