import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import audit, counting


def counts(spark, text, forms, list_bytes=None):
    t = spark.createDataFrame([(1, text)], "id int, raw string").select("id", T.normalize("raw").alias("text"))
    f = spark.createDataFrame([(x,) for x in forms], "form string")
    return {r.form: r.n for r in counting.count_forms(t, f, ["id"], list_bytes=list_bytes).collect()}


def test_golden_counts(spark):
    assert counts(spark, "Душ, душа; ДУШ-душ", ["душ", "Душ"]) == {"душ": 3}
    assert sum(counts(spark, "душевая кабина", ["душевая", "душевая кабина"]).values()) == 2
    assert counts(spark, "50% и %", ["%"]) == {"%": 1}
    assert counts(spark, "а а а", ["а а"]) == {"а а": 1}
    assert counts(spark, "a  b a b", ["a b", "a  b"]) == {"a b": 1, "a  b": 1}
    assert counts(spark, "x", ["", "  "]) == {}
    assert counts(spark, r"q\E q.", [r"q\E", "q."]) == {r"q\e": 1, "q.": 1}
    assert counts(spark, "😀😀 c++ c++ x😀 ++c", ["😀", "c++", "++c", "+"]) == {"😀": 2, "c++": 2, "++c": 1, "+": 3}


def test_shapes(spark):
    forms = ["душ", "a-b", "а а", "%", "a b a", "c++", "(a b)"]
    got = {r._form: (r._class, r._runs) for r in counting.routed(spark.createDataFrame([(f,) for f in forms], "form string")).collect()}
    assert got == {"душ": ("A", 1), "a-b": ("B", 3), "а а": ("C", 3), "%": ("C", 1), "a b a": ("C", 5), "c++": ("C", 2), "(a b)": ("C", 5)}


def test_texts_with_equal_keys_and_scopes(spark):
    t = spark.createDataFrame([(1, "x", "a b a"), (1, "x", "a"), (2, None, "a"), (3, "y", "a b"), (4, "z", None)], "id int, scope string, text string")
    f = spark.createDataFrame([("x", "a"), ("x", "A"), ("y", "b"), (None, "a"), ("z", "a b")], "scope string, form string")
    for limit in (None, 1):
        got = sorted(tuple(r) for r in counting.count_forms(t, f, ["id"], within=["scope"], list_bytes=limit).select("id", "scope", "form", "n").collect())
        assert got == [(1, "x", "a", 3), (3, "y", "b", 1)]


def test_very_long_texts(spark):
    """A text of a million words, by the automaton and by equality joins; n-grams of 200,000 words."""
    words = [f"w{k % 991}" for k in range(1_000_000)]
    t = spark.range(1).select(F.col("id"), F.expr("array_join(transform(sequence(0, 999999), k -> concat('w', k % 991)), ' ')").alias("text"))
    forms = ["w1", "w1 w2", "w990 w0 w1", "w2 w2", "%", " "]
    want = {"w1": words.count("w1"), "w1 w2": sum(a == "w1" and b == "w2" for a, b in zip(words, words[1:], strict=False)), "w990 w0 w1": sum(k % 991 == 990 for k in range(999_998))}
    f = spark.createDataFrame([(x,) for x in forms], "form string")
    for limit in (None, 30):
        assert {r.form: r.n for r in counting.count_forms(t, f, ["id"], list_bytes=limit).collect()} == want
    half = F.expr("array_join(transform(sequence(0, 199999), k -> concat('w', k)), ' ')")
    pairs = spark.range(1).select(F.col("id").alias("pair_id"), F.lit("").alias("source_text"), F.concat(half, F.lit(" w0 w1 w2 "), half).alias("edited_text"))
    got = audit.introduced_patterns(pairs).groupBy("size").agg(F.count("*").alias("n"), F.sum("added").alias("added")).collect()
    assert {r["size"]: (r.n, r.added) for r in got} == {1: (3, 9), 2: (199_999, 399_998 + 2), 3: (199_998, 399_996 + 1)}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ab -%.", max_size=40), st.lists(st.text("ab -%", min_size=1, max_size=5), min_size=1, max_size=6))
def test_all_classes_equal_the_pattern(spark, text, forms):
    want = {}
    for f in {x.strip() for x in forms if x.strip()}:
        n = len(re.findall(r"(?<!\w)" + re.escape(f) + r"(?!\w)", text))
        if n:
            want[f] = n
    assert counts(spark, text, forms) == want
    assert counts(spark, text, forms, 20) == want
