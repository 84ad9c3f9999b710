import json

from test_sources import groups_book, table, workbook

from quillon import sinks
from quillon.__main__ import main
from quillon.operators import audit, content


def files(tmp_path):
    (tmp_path / "a.txt").write_text("Душ душа. Кран 5", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("Душ душ душ кран. Ёлка 6".encode("cp1251"))
    (tmp_path / "g.xlsx").write_bytes(groups_book())
    (tmp_path / "d.xlsx").write_bytes(workbook([("Глубина", table(["Слово", "Словоформы", "Повторы", "Минимум по рекомендациям", "Максимум по рекомендациям", "Добавить/удалить"], ["душ", "душу", 1, 1, 2, -1]))]))
    (tmp_path / "i.txt").write_text("ёлка", encoding="utf-8")
    (tmp_path / "r.txt").write_text("душ, потеряно", encoding="utf-8")
    return [f"--{k}={tmp_path / v}" for k, v in {"source": "a.txt", "text": "b.txt", "lsi": "g.xlsx", "depth": "d.xlsx", "irrelevant": "i.txt", "relevant-groups": "r.txt", "width-words": "r.txt"}.items()]


def test_command(spark, tmp_path, capsys):
    argv = files(tmp_path)
    assert main([*argv, "--strict", "--json", f"--json-output={tmp_path / 'out.json'}"], spark) == 1
    r = json.loads(capsys.readouterr().out)
    assert r == json.loads((tmp_path / "out.json").read_text(encoding="utf-8"))
    assert r["summary"]["lsi_groups"] == 3 and r["summary"]["edited_yo"] == 1 and r["summary"]["irrelevant_above"] == 1
    assert r["fact_tokens"] == {"missing": ["5"], "added": ["6"]}
    assert [g["status"] for g in r["lsi_groups"]] == ["over", "covered", "under"]
    assert r["negative_groups"][0]["synchronized"] is True and r["negative_groups"][0]["target"] == 2
    assert "Релевантная группа не найдена в первых строках: потеряно" in r["warnings"]
    assert main(argv, spark) == 0
    assert capsys.readouterr().out.startswith("SUMMARY\tlsi_groups=3")


def test_command_errors(spark, tmp_path, capsys):
    argv = files(tmp_path)
    assert main([*argv, "--breadth-limit=10"], spark) == 2
    (tmp_path / "g.xlsx").write_bytes(b"no zip")
    assert main(argv, spark) == 2
    assert capsys.readouterr().err.startswith("ERROR\t")


def test_small_rules(spark):
    from test_audit import ANSWERS
    from quillon.sources import texts

    got = sinks.answer_json(texts.answers(spark.createDataFrame(ANSWERS, "key int, json string"))).collect()
    assert [r.code for r in got] == [0, 0, 1] and json.loads(got[0].json)["sources"][2]["source"] == "citation" and json.loads(got[2].json)["ok"] is False
    d = spark.createDataFrame([("s", "a", 5.0, 3.0, -2.0, 1.0), ("s", "b", 5.0, 4.0, -2.0, 2.0)], "scope string, word string, repeats double, maximum double, delta double, median double")
    g = spark.createDataFrame([("s", "A", 9.0), ("s", "b", 2.0)], "scope string, word string, median double")
    assert {(r.word, r.check.split()[0]) for r in audit.sync_checks(d, g).collect()} == {("b", "repeats"), ("a", "median")}
    claims = spark.createDataFrame([("fast",), ("cheap",)], "c string")
    signals = spark.createDataFrame([("fast", False), ("fast", False), ("fast", True)], "c string, agrees boolean")
    rivals = spark.createDataFrame([("fast", "x"), ("fast", "x")], "c string, name string")
    assert {r.c: (r.agree, r.contradict, r.competitors, r.gap) for r in content.aligned_claims(claims, signals, rivals, "c").collect()} == {"fast": (1, 2, 1, True), "cheap": (0, 0, 0, False)}
    reviews = spark.createDataFrame([("a", "Good  one", 1), ("a", "good one ", 5), ("a", None, 3)], "k string, t string, d int")
    assert tuple(content.review_profile(reviews, ["k"], "t", "d").first()) == ("a", 3, 1, 5, 1, 1)
    steps = spark.createDataFrame([("s", "need"), ("s", "buy")], "k string, step string")
    assert content.complete_chain(steps, "k", ["need", "choice", "buy"], "step").first().missing == ["choice"]
    assert [r.layer for r in content.layered(spark.createDataFrame([("rules",), ("post",), (None,)], "kind string"), "kind").collect()] == list(content.LAYERS)
