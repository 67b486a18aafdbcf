"""Office documents, sheets and program code as tables.

Files are read as binary rows, so any store that Spark reads will do, and are
parsed where they are read, one at a time; what becomes of their paragraphs,
cells and functions is DataFrame work. A file that is null, empty or broken
gives no rows; ``broken`` lists such files, but for empty ones, which Spark
doesn't read at all. Files whose names begin with ~$, which office programs
leave as locks, are skipped.
"""

from __future__ import annotations

import ast
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: What a header of a table of appendices holds (fixed value).
APPENDIX = "приложени"

BLOCKS = "kind string, place int, row int, cells array<string>"
CELLS = "sheet string, row int, cells map<string,string>"
FUNCTIONS = "class_name string, name string, first_line int, last_line int, doc string, text string"


def blobs(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """(file, content) of files whose names match the glob ``pattern``."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select(F.col("path").alias("file"), "content")


def parsed(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """The columns of ``files`` but content, with those that ``parse`` makes of each content; files that it fails on give no rows."""
    kept = [f for f in files.schema.fields if f.name != "content"]
    own = T._parse_datatype_string(schema).fields
    types = T.StructType([*kept, *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(batch.schema.get_field_index("content"))[i].as_py()
                rows = attempt(parse, content)
                if rows:
                    same = [pa.array([batch.column(batch.schema.get_field_index(f.name))[i].as_py()] * len(rows), arrow.field(f.name).type) for f in kept]
                    made = [pa.array(column, arrow.field(f.name).type) for column, f in zip(zip(*rows, strict=True), own, strict=True)]
                    yield pa.RecordBatch.from_arrays([*same, *made], schema=arrow)

    return files.mapInArrow(run, types)


def attempt(parse: Callable[[bytes], Iterator[tuple]], content: bytes | None) -> list[tuple] | None:
    """All rows of one file, or None if it can't be read to its end."""
    if content is None:
        return None
    try:
        return list(parse(content))
    except (zipfile.BadZipFile, LookupError, TypeError, EOFError, NotImplementedError, ElementTree.ParseError, SyntaxError, ValueError, RecursionError, zipfile.zlib.error):
        return None


def broken(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """(file): those that ``parse`` can't read to their end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = [f for f, c in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True) if attempt(parse, c.as_py()) is None]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["file"])

    return files.select("file", "content").mapInArrow(run, "file string")


def _said(node: ElementTree.Element) -> str:
    """The text of a paragraph or cell: runs, tabs and breaks in turn; a cell's paragraphs are lines."""
    if node.tag == f"{_W}tc":
        return "\n".join(_said(p) for p in node.iter(f"{_W}p"))
    out = []
    for n in node.iter():
        out.append((n.text or "") if n.tag == f"{_W}t" else "\t" if n.tag == f"{_W}tab" else "\n" if n.tag in (f"{_W}br", f"{_W}cr") else "")
    return "".join(out)


def document_blocks(content: bytes) -> Iterator[tuple]:
    """Of a text document in turn: (``paragraph``, place, null, [text]) and, for each row of a table, (``table``, place, row from 0, cells). Places count both kinds."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        raise ValueError("a document without a body")
    for place, node in enumerate(n for n in body if n.tag in (f"{_W}p", f"{_W}tbl")):
        if node.tag == f"{_W}p":
            yield "paragraph", place, None, [_said(node)]
        else:
            for i, row in enumerate(node.findall(f"{_W}tr")):
                yield "table", place, i, [_said(c) for c in row.findall(f"{_W}tc")]


def sheet_cells(content: bytes) -> Iterator[tuple]:
    """Of a workbook's sheets in turn: (sheet, row as the file numbers it, cells by the header in its first row). Empty cells are left out, and so are rows without any."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target", "").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
            header: dict[str, str] | None = None
            for row in ElementTree.fromstring(z.read(f"xl/{targets[sheet.get(_R)]}")).iter(f"{_S}row"):
                cells = {re.sub(r"\d", "", c.get("r", "")): _value(c, shared) for c in row.findall(f"{_S}c")}
                if header is None:
                    header = {k: v for k, v in cells.items() if v}
                elif any(cells.values()):
                    yield sheet.get("name"), int(row.get("r")), [(header[k], v) for k, v in cells.items() if v and k in header]


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    v = cell.find(f"{_S}v")
    return None if v is None or v.text is None else shared[int(v.text)] if cell.get("t") == "s" else v.text


def code_functions(content: bytes) -> Iterator[tuple]:
    """Functions at the top and in classes there: (class, name, first and last line, documentation, text); then the module's own, under the name __module__."""
    source = content.decode("utf-8")
    lines, tree = source.splitlines(), ast.parse(source)
    owners = [("", tree), *((n.name, n) for n in tree.body if isinstance(n, ast.ClassDef))]
    found = [(owner, n) for owner, of in owners for n in of.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for owner, n in sorted(found, key=lambda f: f[1].lineno):
        yield owner, n.name, n.lineno, n.end_lineno, (ast.get_docstring(n) or "").strip(), "\n".join(lines[n.lineno - 1 : n.end_lineno])
    if told := ast.get_docstring(tree):
        yield "", "__module__", 1, 1, told.strip(), told.strip()


def functions(spark: SparkSession, path: str | list[str], pattern: str = "*.py") -> DataFrame:
    """(file, class_name, name, first_line, last_line, doc, text, full_name, locator) of program files."""
    rows = parsed(blobs(spark, path, pattern), code_functions, FUNCTIONS)
    full = F.when(F.col("class_name") == "", F.col("name")).otherwise(F.concat_ws(".", "class_name", "name"))
    name = F.element_at(F.split("file", "/"), -1)
    return rows.withColumns({"full_name": full, "locator": F.concat(name, F.lit(":"), full, F.lit(":"), F.col("first_line").cast("string"), F.lit("-"), F.col("last_line").cast("string"))})


def documents(spark: SparkSession, path: str | list[str], pattern: str = "*.docx") -> DataFrame:
    """(file, kind, place, row, cells) of text documents."""
    return parsed(blobs(spark, path, pattern), document_blocks, BLOCKS)


def paragraphs(blocks: DataFrame) -> DataFrame:
    """(file, place, text) of the paragraphs outside of tables that have any text."""
    text = F.trim(F.regexp_replace(F.col("cells")[0], r"^\s+|\s+$", ""))
    return blocks.where("kind = 'paragraph'").select("file", "place", text.alias("text")).where("text <> ''")


def sheets(spark: SparkSession, path: str | list[str], pattern: str = "*.xlsx") -> DataFrame:
    """(file, sheet, row, cells) of workbooks, cells being a map as ``cascade`` takes it."""
    return parsed(blobs(spark, path, pattern), sheet_cells, CELLS)


def appendix_rows(blocks: DataFrame) -> DataFrame:
    """(file, place, row, appendix, title, table_no) of tables one of whose headers names appendices: rows of three cells or more, of which the first is a number and the third has one, the table's."""
    rows = blocks.where("kind = 'table'")
    headed = rows.where((F.col("row") == 0) & F.exists("cells", lambda c: F.contains(F.lower(c), F.lit(APPENDIX)))).select("file", "place")
    cell = lambda i: F.trim(F.get("cells", F.lit(i)))
    own = rows.where((F.col("row") > 0) & (F.size("cells") >= 3)).join(headed, ["file", "place"], "left_semi")
    made = own.select("file", "place", "row", cell(0).alias("appendix"), cell(1).alias("title"), F.regexp_extract(cell(2), r"(\d+)", 1).alias("table_no"))
    return made.where(F.col("appendix").rlike(r"^\d+$") & (F.col("table_no") != ""))


def table_titles(appendices: DataFrame) -> DataFrame:
    """(table_no, title, appendix, file): what the first document, by name and place, calls each table."""
    first = Window.partitionBy("table_no").orderBy("file", "place", "row")
    return appendices.where("title <> ''").withColumn("_r", F.row_number().over(first)).where("_r = 1").select("table_no", "title", "appendix", "file")
