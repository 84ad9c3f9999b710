from helpers_llm import duck, empty, odd, rows, saved, text
from pyspark.sql import functions as F

from quillon.llm import lines, mixing


def brute_lines(docs):
    """Kept text by (doc_id, text): later three-line windows removed, nulls last."""
    seen, out = set(), {}
    for i, t in sorted(set(docs), key=lambda r: (r[0] is None, r[0] or 0)):
        if t is None:
            continue
        own = t.split("\n")
        gone = set()
        for p in range(len(own) - 2):
            k = tuple(own[p : p + 3])
            if k in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(k)
        out[i, t] = "\n".join(x for p, x in enumerate(own) if p not in gone), len(gone)
    return out


def test_lines_small_cases(spark):
    a, b, c, d = (text(k, 4) for k in (1, 2, 3, 4))
    made = [(1, f"{a}\n{b}\n{c}\n{d}"), (2, f"{d}\n{a}\n{b}\n{c}\n{d}\nnew"), (3, f"{a}\n{b}\n{c}\n{a}\n{b}\n{c}"), (4, f"{a}\n{b}"), (5, None), (None, f"x\n{b}\n{c}\n{d}"), (6, "\n\n\n\n\n"), (7, "")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    want = brute_lines(made)
    got = lines.dedup(df).collect()
    assert len(got) == len(made)
    texts = {r.doc_id: (r.text, r.n_removed) for r in got}
    for i, t in made:
        assert texts[i] == ((None, 0) if t is None else want[i, t])
    assert texts[2] == (f"{d}\nnew", 4)
    assert texts[6][0] == ""


def test_lines_odd_rows_and_sql(spark, tmp_path):
    out = lines.dedup(odd(spark))
    assert out.count() == 13 and set(out.columns) == {*odd(spark).columns, "n_lines", "n_removed"}
    clash = lines.dedup(odd(spark).withColumns({c: F.lit("x") for c in ("__q_gone", "__q_text", "__Q__id", "lines")}))
    assert clash.filter("doc_id = 8").select("text", "__q_gone", "__q_text", "lines").first() == ("last line", "x", "x", "x")
    assert [tuple(r) for r in out.filter("doc_id = 6").select("text", "n_removed").collect()] == [(text(5, 40), 0)] * 2
    assert out.filter("doc_id = 8").first().text == "last line"
    assert lines.dedup(empty(spark)).count() == 0
    unique = odd(spark).filter("doc_id is not null and doc_id <> 6").select("doc_id", "text")
    folder = saved(unique, tmp_path)
    assert rows(lines.op2_line_dedup(spark, folder)) == duck(lines.SQL, documents=unique)


def test_mixing_meets_targets(spark):
    made = [(i, "w " * (5 + i % 11) + ("| " * 9 if i % 4 == 0 else ""), "en" if i % 3 else "de", "big" if i % 7 < 4 else f"s{i % 5}", 0) for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    r = mixing.mixed(df, share=0.4).cache()
    total = r.agg(F.sum("_tokens")).first()[0]
    for k in ("_source", "_lang", "_topic"):
        power = mixing.POWERS[k[1:]]
        seen = {x[0]: (x[1], x[2]) for x in r.groupBy(k).agg(F.sum("_tokens"), F.sum(F.col("_weight") * F.col("_tokens"))).collect()}
        norm = sum(v[0] ** power for v in seen.values())
        for v in seen.values():
            assert abs(v[1] / total - v[0] ** power / norm) < 1e-6
    expected = r.agg(F.sum(F.col("_probability") * F.col("_tokens"))).first()[0]
    assert abs(expected / total - 0.4) < 1e-6
    kept = r.filter("_kept").agg(F.sum("_tokens")).first()[0]
    assert abs(kept / total - 0.4) < 0.05


def test_mixing_draws_meet_targets_at_production_share(spark):
    """The sources are lifted past 1 in many cells, and lists have fewer tokens than their target."""
    made = [(i, "w " * (5 + i % 11) + ("| " * 9 if i % 16 == 0 else ""), "en" if i % 3 else "de", "big" if i % 7 < 4 else f"s{i % 35 % 6}", 0) for i in range(3000)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    r = mixing.mixed(df).cache()
    total = r.agg(F.sum("_tokens")).first()[0]
    assert r.filter("_probability = 1").count() > 0
    short = 0
    for k in ("_source", "_lang", "_topic"):
        seen = {x[0]: (x[1], x[2]) for x in r.groupBy(k).agg(F.sum("_tokens"), F.sum(F.col("_probability") * F.col("_tokens"))).collect()}
        left, goals, want = mixing.SHARE * total, {g: n ** mixing.POWERS[k[1:]] for g, (n, _) in seen.items()}, {}
        while over := [g for g in goals if left * goals[g] / sum(goals.values()) >= seen[g][0]]:
            for g in over:  # kept whole
                want[g], short = seen[g][0], short + 1
                left -= want[g]
                del goals[g]
        want |= {g: left * v / sum(goals.values()) for g, v in goals.items()}
        for g, (_, got) in seen.items():
            assert abs(got - want[g]) < 1e-5 * total
    assert short > 0


def test_mixing_odd_rows_and_sql(spark, tmp_path):
    r = mixing.mixed(odd(spark))
    assert r.count() == 13 and r.filter("_probability is null or _kept is null").count() == 0
    assert len({x._kept for x in r.filter("doc_id = 6").collect()}) == 1
    assert mixing.mixed(empty(spark)).count() == 0
    plain = odd(spark).select("doc_id", "text", "lang", "source")
    folder = saved(plain, tmp_path)
    assert [(x[0], x[1], x[5]) for x in rows(mixing.op10_mixing(spark, folder))] == [(x[0], x[1], x[5]) for x in duck(mixing.sql(), documents=plain)]
