import pytest
from helpers_llm import empty, odd, saved, text
from test_dedup import brute_components
from test_lines_mixing import brute_lines

import corpus_pipeline
from quillon.llm import mixing, pieces, shared

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage over the smallest documents."""
    docs, base, out = spark.read.parquet(f"{SF}/documents.parquet"), shared.shared_dir(spark), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = shared.stored(stage(spark, docs, SF), f"t{k}", base)
        out.append((name, docs.collect(), made.collect(), made.columns))
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    for _, _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [s[0] for s in stages] == ["quality", "line dedup", "near dedup", "mixing", "sentencepiece"]


def test_quality_stage_keeps_what_is_labelled_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[0][2]}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 1


def test_line_stage_equals_brute_force(stages):
    _, before, after, _ = stages[1]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    cut = {r.doc_id: want[r.doc_id, r.text] for r in before}
    assert {r.doc_id: r.text for r in after} == {i: t for i, (t, n) in cut.items() if n == 0 or t}
    assert all(r.n_chars == len(r.text) for r in after if cut[r.doc_id][1])


def test_near_stage_equals_brute_force(stages):
    _, before, after, _ = stages[2]
    marks = brute_components([(r.doc_id, r.text) for r in before], 80, 100)
    assert {r.doc_id for r in after} == {m[0] for m in marks if m[3]}


def test_near_stage_tells_rows_apart(spark):
    """Rows of one doc_id with different texts are documents of their own; rows equal in both are one."""
    made = [(1, text(1, 30), "en", "a", 1), (1, text(2, 30), "en", "a", 1), (2, text(2, 30) + " end", "en", "b", 1), (3, text(3, 30), "en", "b", 1), (3, text(3, 30), "en", "b", 2), (None, text(4, 30), None, None, None), (None, text(3, 30), None, None, None), (4, None, "en", "a", 0)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    assert sorted(got, key=repr) == sorted([(1, text(1, 30)), (1, text(2, 30)), (3, text(3, 30)), (None, text(4, 30)), (4, None)], key=repr)


def test_mixing_stage_draws_by_probability(spark, stages):
    _, before, after, _ = stages[3]
    df = spark.createDataFrame(before)
    want = {r.doc_id for r in mixing.mixed(df).filter("_kept").select("doc_id").collect()}
    assert {r.doc_id for r in after} == want and 0 < len(want) < len(before)


def test_last_stage_encodes_whole_texts(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    _, before, after, _ = stages[4]
    assert {r.doc_id: r.ids for r in after} == {r.doc_id: library.encode(r.text) for r in before}
    assert all(r.n_ids == len(r.ids) for r in after)


def test_run_takes_odd_and_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, saved(odd(spark).select("doc_id", "text", "lang", "source", "n_chars", "h"), tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_ids", "ids"]
    ids = [r.doc_id for r in got.filter("doc_id is not null").collect()]
    assert len(ids) == len(set(ids)) and not {1, 2, 3} & set(ids)
    assert corpus_pipeline.run(spark, saved(empty(spark), tmp_path)).count() == 0


def test_stages_equal_run(spark, stages):
    got = {r.doc_id: r.n_ids for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_ids").collect()}
    assert got == {r.doc_id: r.n_ids for r in stages[-1][2]}
