"""Hand-derived values of the text functions."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T


def value(spark, expression, x):
    return spark.createDataFrame([(x,)], "x string").select(expression("x").alias("v")).first().v


CASES = [
    (T.normalize, "Ёлка", "елка"),
    (T.normalize, "Straße", "strasse"),
    (T.normalize, None, ""),
    (T.normalize, "ΑΣ ς µ ſ", "ασ σ μ s"),
    (T.normalize, "ﬁn ŉ ΐ Ａ Ⅷ Ꭰ ἈΙ ᾳ", "ﬁn ŉ ΐ Ａ Ⅷ Ꭰ ἈΙ ᾳ".casefold()),
    (T.normalize_header, "  Текст \n У   ВАС ", "текст у вас"),
    (T.number, "1,5", 1.5),
    (T.number, " 7 ", 7.0),
    (T.number, "", None),
    (T.number, "1 234", None),
    (T.number, "12d", None),
    (T.number, "1_000", 1000.0),
    (T.number, "nan", None),
    (T.number, "inf", None),
    (T.number, "1e400", None),
    (T.number, "-.5", -0.5),
    (T.number, "-3.50", -3.5),
    (T.number, "1e3", 1000.0),
    (T.number, "abc", None),
    (T.number, "0", 0.0),
    (T.number, None, None),
    (T.relation_key, "3", "3"),
    (T.relation_key, "3.0", "3"),
    (T.relation_key, "3,0", "3"),
    (T.relation_key, "A  b", "a b"),
    (T.relation_key, "", ""),
    (T.relation_key, "1,5", "1.5"),
    (T.relation_key, " 7 ", "7"),
    (T.relation_key, "1_000", "1000"),
    (T.relation_key, "12d", "12d"),
    (T.relation_key, None, ""),
    (T.column_ordinal, "A1", 0),
    (T.column_ordinal, "Z9", 25),
    (T.column_ordinal, "AA10", 26),
    (T.column_ordinal, "10", 0),
    (T.split_forms, "a, b;;c\r\n d", ["a", "b", "c", "d"]),
    (T.split_forms, None, []),
    (T.split_forms, "", []),
    (T.split_forms, " , ;", []),
    (T.split_forms, "one", ["one"]),
    (T.tokens, "-abc abc- a--b x_1", ["abc", "abc", "a--b", "x_1"]),
    (T.fact_tokens, "12,5 см и 50%", ["%", "12", "5", "50"]),
    (T.fact_tokens, "IP67-a ё5", ["5", "ip67-a"]),
    (T.fact_tokens, None, []),
    (T.fact_tokens, "5\u212a 7\u017f \u1c82-9", ["5k", "7s", "9"]),
    (T.fact_tokens, "5ß ß7 K5 ٣x٤ x-5-", ["5", "5-", "7", "k5", "٣x", "٤"]),
    (lambda x: T.fact_tokens(x, True), "12,5 см", ["12.5"]),
    (T.letter_count, "Ёж ёлка е", 2),
    (T.clean_number, None, None),
    (lambda x: T.clean_number(F.col(x).cast("double")), "3.0", "3"),
    (lambda x: T.clean_number(F.col(x).cast("double")), "2.5", "2.5"),
    (lambda x: T.route_by_length(F.col(x).cast("int")), "2500", "simple"),
    (lambda x: T.route_by_length(F.col(x).cast("int")), "6000", "standard"),
    (lambda x: T.route_by_length(F.col(x).cast("int")), "6001", "complex"),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_value(spark, k):
    expression, x, want = CASES[k]
    if expression is T.clean_number:
        expression = lambda c: T.clean_number(F.col(c).cast("double"))
    assert value(spark, expression, x) == want


def test_folding_equals_the_rule(spark):
    """Every letter of the first planes that Unicode 13 knows, folded as the language's own rule does."""
    import unicodedata

    letters = [c for c in map(chr, range(0x80, 0x1E000)) if unicodedata.category(c)[0] == "L" and unicodedata.ucd_3_2_0.category(c)[0] == "L"]
    text = " ".join(letters)
    want = text.casefold().replace("ё", "е")
    got = value(spark, T.normalize, text)
    differ = [(a, x, y) for a, x, y in zip(letters, got.split(" "), want.split(" "), strict=True) if x != y]
    assert not differ


def test_digits(spark):
    df = spark.createDataFrame([(x,) for x in ("12", "x²", "²³", "①", "٣", "½", "")], "v string")
    assert [r[0] for r in df.select(T.is_digits("v")).collect()] == [x.isdigit() for x in ("12", "x²", "²³", "①", "٣", "½", "")]


def test_zero_cell_is_blank(spark):
    df = spark.createDataFrame([("0", True), ("0", False), (None, False), ("5", True), ("0.0", True)], "v string, n boolean")
    assert [r[0] for r in df.select(T.cell("v", F.col("n"))).collect()] == ["", "0", "", "5", ""]
