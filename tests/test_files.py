"""Documents, sheets and code as tables, from files written by hand; broken ones give no rows."""

import zipfile

from evidentia.operators import cascade
from evidentia.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(*runs):
    return f"<w:p>{''.join(f'<w:r><w:t>{t}</w:t></w:r>' for t in runs)}</w:p>"


def table(*rows):
    return f"<w:tbl>{''.join('<w:tr>' + ''.join(f'<w:tc>{p(c)}</w:tc>' for c in r) + '</w:tr>' for r in rows)}</w:tbl>"


def docx(path, *body):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}<w:sectPr/></w:body></w:document>")


def xlsx(path, rows, shared=()):
    cells = "".join(f'<row r="{n}">{"".join(c)}</row>' for n, c in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="Lines" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}>{''.join(f'<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>' for s in shared)}</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {S}><sheetData>{cells}</sheetData></worksheet>")


def test_paragraphs_tables_and_titles(spark, tmp_path):
    docx(tmp_path / "b.docx", p("Номер ", "документа: ТР-1-2026."), p("  "), table(["№ приложения", "Наименование приложения", "Файл"], ["5", "Линии печати", "табл. 3"], ["x", "нет", "4"], ["6", "Блоки", "12, 13"], ["7", "мало"]), p("3.2. Проверять блок"))
    docx(tmp_path / "a.docx", table(["Приложение", "b", "c"], ["1", "Другие линии", "3"], ["2", "", "12"]), table(["x", "y", "z"], ["1", "ничто", "3"]))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    (tmp_path / "d.docx").write_bytes(b"")
    (tmp_path / "~$a.docx").write_bytes((tmp_path / "a.docx").read_bytes())
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document")
    blocks = files.documents(spark, str(tmp_path))
    name = lambda f: f.rsplit("/", 1)[1]
    assert {name(r["file"]) for r in blocks.collect()} == {"a.docx", "b.docx"}
    assert [(r["place"], r["text"]) for r in files.paragraphs(blocks).orderBy("place").collect()] == [(0, "Номер документа: ТР-1-2026."), (3, "3.2. Проверять блок")]
    rows = files.appendix_rows(blocks)
    assert sorted((name(r["file"]), r["row"], r["appendix"], r["title"], r["table_no"]) for r in rows.collect()) == [
        ("a.docx", 1, "1", "Другие линии", "3"), ("a.docx", 2, "2", "", "12"), ("b.docx", 1, "5", "Линии печати", "3"), ("b.docx", 3, "6", "Блоки", "12"),
    ]
    assert {(r["table_no"], r["title"], name(r["file"])) for r in files.table_titles(rows).collect()} == {("3", "Другие линии", "a.docx"), ("12", "Блоки", "b.docx")}
    bad = files.broken(files.blobs(spark, str(tmp_path), "*.docx"), files.document_blocks)
    assert {name(r["file"]) for r in bad.collect()} == {"c.docx", "e.docx"}  # Spark lists no empty file


def test_sheets_are_tables_that_lookups_take(spark, tmp_path):
    c = lambda ref, v, t="": f'<c r="{ref}"{t}><v>{v}</v></c>'
    s = ' t="s"'
    xlsx(tmp_path / "3_lines.xlsx", [(1, [c("A1", 0, s), c("B1", 1, s)]), (2, [c("A2", 2, s), c("B2", "40.5"), c("C2", 9)]), (4, ['<c r="A4" t="inlineStr"><is><t>ЛП2</t></is></c>', '<c r="B4"/>']), (5, ['<c r="A5"/>'])], ["Линия", "Калибр", "ЛП1"])
    xlsx(tmp_path / "9_none.xlsx", [])
    xlsx(tmp_path / "8_bad.xlsx", [(1, [c("A1", 7, s)])], [])  # a string that isn't there
    rows = files.sheets(spark, str(tmp_path))
    assert sorted((r["sheet"], r["row"], sorted(r["cells"].items())) for r in rows.collect()) == [("Lines", 2, [("Калибр", "40.5"), ("Линия", "ЛП1")]), ("Lines", 4, [("Линия", "ЛП2")])]
    stored = rows.selectExpr("'3' as table_no", "cast(row as long) as row", "cells")
    catalogue = spark.createDataFrame([(0, "3", "lines", "Линии", None, None)], "place int, table_no string, slug string, title string, document string, appendix string")
    headers = spark.createDataFrame([("3", 0, "Линия"), ("3", 1, "Калибр")], "table_no string, position int, column string")
    calls = spark.createDataFrame([(1, "линии", [("линия", "ЛП2")])], "call int, ref string, filters array<struct<name:string,value:string>>")
    assert cascade.lookups(calls, catalogue, headers, stored).first()["detail"] == "table 3, row 4"


SOURCE = '''"""What it does."""
import os


def top(a):
    """Says a."""
    def inner():
        return 1
    return a


class Stage:
    value = 1

    @property
    async def run(self):
        return self.value
'''


def test_functions_with_their_lines(spark, tmp_path):
    (tmp_path / "demo").mkdir()
    (tmp_path / "demo" / "ring.py").write_text(SOURCE)
    (tmp_path / "bad.py").write_text("def (:\n")
    (tmp_path / "latin.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "empty.py").write_text("")
    rows = files.functions(spark, str(tmp_path))
    assert [tuple(r)[1:6] + (r["full_name"], r["locator"]) for r in rows.orderBy("first_line", "name").collect()] == [
        ("", "__module__", 1, 1, "What it does.", "__module__", "ring.py:__module__:1-1"), ("", "top", 5, 9, "Says a.", "top", "ring.py:top:5-9"), ("Stage", "run", 16, 17, "", "Stage.run", "ring.py:Stage.run:16-17"),
    ]
    assert rows.where("name = 'top'").first()["text"].splitlines() == SOURCE.splitlines()[4:9]
    bad = files.broken(files.blobs(spark, str(tmp_path), "*.py"), files.code_functions).collect()
    assert {r["file"].rsplit("/", 1)[1] for r in bad} == {"bad.py", "latin.py"}


def test_null_content_gives_no_rows(spark):
    none = spark.createDataFrame([("x", None)], "file string, content binary")
    assert files.parsed(none, files.document_blocks, files.BLOCKS).count() == 0 and files.broken(none, files.document_blocks).count() == 1
