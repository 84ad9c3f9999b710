import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import audit, targets
from quillon.plans import fixtures
from quillon.sources import texts, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def cell(ref, v, kind=None):
    if kind == "inlineStr":
        return f'<c r="{ref}" t="inlineStr"><is><r><t>{v[0]}</t></r><r><t>{v[1:]}</t></r></is></c>'
    t = f' t="{kind}"' if kind else ""
    return f'<c r="{ref}"{t}/>' if v is None else f'<c r="{ref}"{t}><v>{v}</v></c>'


def sheet(rows):
    body = "".join(f"<row>{''.join(cell(*c) for c in r)}</row>" for r in rows)
    return f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>"


def table(*lines):
    """Rows of plain values as cells."""
    return [[(f"{chr(65 + k)}{n}", v, None if isinstance(v, (int, float)) else "str") for k, v in enumerate(line) if v is not None] for n, line in enumerate(lines, 1)]


def workbook(sheets, strings=(), targets_=None, extra=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {MAIN}><sheets>{listed}{extra or ''}</sheets></workbook>")
        rel = "".join(f'<Relationship Id="r{k}" Target="{(targets_ or {}).get(k, f"worksheets/sheet{k}.xml")}"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(strings)}</sst>")
        for k, (_, rows) in enumerate(sheets, 1):
            if rows is not None:
                z.writestr(f"xl/worksheets/sheet{k}.xml", sheet(rows))
    return out.getvalue()


def cells(spark, tmp_path, data, name="book.xlsx"):
    (tmp_path / name).write_bytes(data)
    xlsx.register(spark)
    return spark.read.format("xlsx_cells").load(str(tmp_path / name))


def test_cell_kinds():
    rows = [[("A1", "0", "s"), ("B1", "9", "s"), ("C1", "hi", "inlineStr"), ("D1", "5", "str"), ("E1", "#N/A", "e"), ("F1", "3.0"), ("G1", None), ("H1", "1,5"), ("AA1", "x"), ("J1", "1", "b")], [], [("A3", "1"), ("D3", "2.5")]]
    got = [(r[3], r[4], r[6], r[7]) for r in xlsx.cells_of(workbook([("S", rows)], ["<si><r><t>ri</t></r><r><t>ch</t></r></si>"]))]
    assert got == [(0, 0, "rich", False), (0, 1, "9", False), (0, 2, "hi", False), (0, 3, "5", False), (0, 4, "#N/A", False), (0, 5, "3", True), (0, 6, "", False), (0, 7, "1.5", True), (0, 26, "x", False), (0, 9, "1", True), (1, 0, "1", True), (1, 3, "2.5", True)]


def test_parts_and_orders():
    one = table(["x"])
    data = workbook([("first", one), ("gone", None), ("third", one)], targets_={1: "/xl/worksheets/sheet1.xml", 3: "xl/worksheets/sheet3.xml"})
    assert [(r[0], r[1]) for r in xlsx.cells_of(data)] == [(0, "first"), (1, "third")]
    many = workbook([(f"n{k}", one) for k in range(1, 12)])
    assert [r[1] for r in xlsx.cells_of(many)] == [f"n{k}" for k in range(1, 12)]
    assert [r[1] for r in xlsx.cells_of(many, "part")] == ["n1", "n10", "n11"] + [f"n{k}" for k in range(2, 10)]


def test_reader_and_dump(spark, tmp_path):
    data = workbook([("S", table(["a", None, 5], [7]))])
    c = cells(spark, tmp_path, data)
    lines = [r.line for r in xlsx.dump(c).orderBy("sheet_ix", "row_ix").collect()]
    assert lines == [f"FILE {tmp_path}/book.xlsx", "SHEET S (xl/worksheets/sheet1.xml)", "A1=a\tC1=5", "A2=7"]
    binary = spark.read.format("binaryFile").load(str(tmp_path / "book.xlsx"))
    assert sorted(r[1:] for r in map(tuple, xlsx.from_binary(binary).collect())) == sorted(r[1:] for r in map(tuple, c.collect()))


def test_sheets_are_partitions_and_filters_are_pushed(spark, tmp_path):
    rows = [[(f"A{n}", str(n % 3), "s"), (f"B{n}", "t", "inlineStr"), (f"C{n}", n)] for n in range(1, 40)]
    for name in ("a", "b"):
        cells(spark, tmp_path, workbook([("one", rows), ("two", rows[:5])], ["<si><t>x</t></si>", "<si><t>y</t></si>", "<si/>"]), f"{name}.xlsx")
    for path in (f"{tmp_path}", f"file://{tmp_path}", f"{tmp_path}/*.xlsx"):
        c = spark.read.format("xlsx_cells").load(path)
        assert c.rdd.getNumPartitions() == 4 and c.count() == 2 * (39 + 5) * 3
    part = c.filter("sheet = 'two' and col_ix in (0, 2) and row_ix > 1")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "> 1)" in plan and "= two" not in plan.split("BatchScan")[0] and " IN " not in plan.split("BatchScan")[0]
    assert part.rdd.getNumPartitions() == 2
    assert sorted((r.ref, r.value) for r in part.filter(f"file = '{tmp_path}/a.xlsx'").collect()) == [("A3", "x"), ("A4", "y"), ("A5", ""), ("C3", "3"), ("C4", "4"), ("C5", "5")]
    whole = xlsx._Reader({"path": str(tmp_path)})
    assert sorted(map(tuple, (r.values() for p in [xlsx._Part(f"{tmp_path}/a.xlsx")] for b in whole.read(p) for r in b.to_pylist()))) == sorted(tuple(r) for r in c.filter(f"file = '{tmp_path}/a.xlsx'").collect())
    with pytest.raises(Exception, match="none"):
        spark.read.format("xlsx_cells").load(f"{tmp_path}/none*.xlsx").collect()


def test_a_workbook_larger_than_what_is_held(tmp_path):
    """60 MB of XML, half of it shared strings, in a few megabytes of memory."""
    import tracemalloc

    n = 120_000
    path = tmp_path / "big.xlsx"
    path.write_bytes(workbook([("S", [[(f"A{k}", str(k), "s"), (f"B{k}", k)] for k in range(1, n)])], [f"<si><t>{'text ' * 40}{k}</t></si>" for k in range(n)]))
    reader = xlsx._Reader({"path": str(path)})
    (part,) = reader.partitions()
    tracemalloc.start()
    seen = 0
    for batch in reader.read(part):
        seen += batch.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 2 * (n - 1) and batch.column(7)[-2].as_py().endswith(str(n - 1)) and peak < 24 << 20


def groups_book():
    head = ["Слова", "Медиана (по топ-10)", "Связь слов с другим листом", "Текст у вас"]
    summary = table(head, ["душ", "2", 1, 3], ["Душ", "9", 1, 3], ["кран", "", "b", None], [0, 5, 1, 1], ["лейка", "1,5", "none", 0])
    forms = table(head[:3], ["душа", 1, "1,0"], ["ДУШЕМ", 1, 1.0], ["крана", 1, " B "], ["x", 1, ""])
    return workbook([("Все формы", forms), ("Сводим формы", summary)])


def test_group_table(spark, tmp_path):
    g = targets.group_table(cells(spark, tmp_path, groups_book()), limit=150).orderBy("breadth_rank").collect()
    assert [(r.breadth_rank, r.word, r.forms, r.median, r.analyzer_current) for r in g] == [(1, "душ", ["душ", "душа", "душем"], 2.0, 3.0), (2, "кран", ["кран", "крана"], None, None), (3, "лейка", ["лейка"], 1.5, 0.0)]
    assert targets.group_table(cells(spark, tmp_path, groups_book()), limit=2).count() == 2


def test_depth_table_and_supplement(spark, tmp_path):
    book = workbook([("Глубина", table(["Слово", "Словоформы", "Повторы", "Минимум по рекомендациям", "Максимум по рекомендациям", "Добавить/удалить"], ["душ", "душу, душе", 5, 1, 3, -2], [" ", "x", 1], ["ДУШ", "душами", "-", "", "", ""]))])
    d = targets.depth_table(cells(spark, tmp_path, book, "depth.xlsx"))
    got = d.orderBy("row_ix").collect()
    assert [(r.word, r.forms, r.repeats, r.minimum, r.maximum, r.delta) for r in got] == [("душ", ["душ", "душе", "душу"], 5.0, 1.0, 3.0, -2.0), ("ДУШ", ["душ", "душами"], None, None, None, None)]
    g = cells(spark, tmp_path, groups_book())
    from pyspark.sql import functions as F

    top = targets.group_table(g.withColumn("file", F.lit("f")), d.withColumn("file", F.lit("f"))).orderBy("breadth_rank").first()
    assert top.forms == ["душ", "душа", "душами", "душем"]


def test_wrong_workbooks(spark, tmp_path):
    with pytest.raises(ValueError, match="numeric"):
        targets.depth_table(cells(spark, tmp_path, workbook([("d", table(["слово", "словоформы"], ["a", "b"]))]))).collect()
    titled = workbook([("s", table(["Отчёт"], ["слово", "словоформы", "повторы"], ["a", "b", 1]))])
    with pytest.raises(ValueError, match="depth"):
        targets.depth_table(cells(spark, tmp_path, titled)).collect()


def test_hint_wins(spark, tmp_path):
    head, row = ["N-граммы", "Медианное вхождение", "На нашем сайте"], ["a b", 2, 1]
    book = workbook([("other", table(head, ["no", 1, 1])), ("N-граммы тут", table(head, row, ["", 1, 1], ["c", "x", 1]))])
    assert [tuple(r)[2:] for r in targets.phrase_table(cells(spark, tmp_path, book)).collect()] == [("a b", 2.0, 1.0)]


def test_charsets(spark, tmp_path):
    for name, data in {"a": "﻿Привет ё".encode(), "b": "Привет ё".encode(), "c": "Привет ё № —".encode("cp1251")}.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    got = {r.path[-5]: r.text for r in texts.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"a": "Привет ё", "b": "Привет ё", "c": "Привет ё № —"}


def test_lists(spark):
    lists = spark.createDataFrame([("s", "Душ, ДУШ;кран\r\n\nёлка,елка"), ("t", "x"), ("u", None)], "scope string, text string")
    got = texts.word_list(lists).orderBy("scope", "row_ix").collect()
    assert [(r.scope, r.word, r.key) for r in got] == [("s", "Душ", "душ"), ("s", "кран", "кран"), ("s", "ёлка", "елка"), ("t", "x", "x")]
    text = "Нерелевантные слова\nНерелевантное слово (точная словоформа) навсегда у вас повторяется 4 раз(а)\nможно -> 1, важно"
    forms = texts.unwanted_forms(spark.createDataFrame([("s", text)], "scope string, text string")).orderBy("row_ix").collect()
    assert [(r.form, r.reported_current, r.target) for r in forms] == [("навсегда", 4, 0), ("можно", None, 1), ("важно", None, 0)]


def test_limit_range():
    with pytest.raises(ValueError):
        audit.AuditConfig(breadth_limit=10)
    assert audit.AuditConfig(breadth_limit=10, enforce_limit_range=False).breadth_limit == 10


def test_sheets_in_memory_are_tasks_of_their_own(spark):
    """Rows of a workbook are taken one by one, and its sheets are parsed apart; an order of parts holds too."""
    taken = []

    def rows(name):
        for k in range(3000):
            taken.append((name, k))
            yield [f"{name}{k}", None, k]

    book = fixtures.workbook({n: rows(n) for n in "abc"})
    assert len(taken) == 9000
    files = spark.createDataFrame([("f", book)], "path string, content binary")
    for order in ("workbook", "part"):
        cells = xlsx.from_binary(files, order)
        got = sorted(tuple(r) for r in cells.collect())
        assert got == sorted(("f", *c) for c in xlsx.cells_of(book, order)) and len(got) == 18_000
        assert cells.select(F.spark_partition_id()).distinct().count() > 1 and cells.rdd.getNumPartitions() == xlsx.SHEETS * spark.sparkContext.defaultParallelism
