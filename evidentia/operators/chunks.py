"""Rules and code cut into chunks: clauses with their sections, heads of documents, the tables that a text refers to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAUSE, SECTION = r"^(\d+\.\d+)[.\s]+(\S.*)$", r"^(\d+)\.\s+(\S.*)$"
APPENDIX, TABLE = r"(?iu)прилож[\wа-яё]*\s*((?:\d+\s*(?:,|и|\s)\s*)*\d+)", r"(?iu)табл[\wа-яё]*\.?\s*(\d+)"
#: Titles of sections that have nothing to do with planning hold one of these (fixed values).
OFF_TOPIC = ("охран", "уборк", "обслуживание помещений", "заключительн")
#: Names of stages as titles have them (fixed values).
TITLE_STAGES = {"экструзии": "экструзия", "печати": "печать", "кольцевания": "кольцевание"}
#: Index names in code and the tables behind them (fixed values).
ALIASES = {
    "perf_index": "extrusion_outcome", "color_index": "color_matrix", "minblock_index": "minimal_blocks", "assort_index": "assortment", "waste_exceptions": "waste_exceptions",
    "print_lines_by_type": "print_equipment_sets", "print_perf": "print_outcome", "print_types": "print_types_sets", "store_index": "print_days_before",
}


def _mapped(found: Column, names: dict[str, str]) -> Column:
    """The values of those of ``found`` that ``names`` has."""
    if not names:
        return F.array().cast("array<string>")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.filter(F.transform(found, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull())


def by_number(c: Column) -> Column:
    """An array of digits, each once, in the order of their numbers."""
    pairs = F.transform(F.array_distinct(c), lambda x: F.struct(x.cast("long").alias("n"), x.alias("t")))
    return F.transform(F.array_sort(pairs), lambda p: p["t"])


def referenced_tables(c: Column, appendix: dict[str, str]) -> Column:
    """Numbers of the tables that a clause names, also by appendix (number of appendix -> number of table)."""
    body = F.coalesce(c, F.lit(""))
    lists = F.transform(F.regexp_extract_all(body, F.lit(APPENDIX), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)))
    return by_number(F.concat(_mapped(F.flatten(lists), appendix), F.regexp_extract_all(body, F.lit(TABLE), F.lit(1))))


def code_tables(c: Column, numbers: dict[str, str]) -> Column:
    """Numbers of the tables that source code uses: by key, by index name or by number. ``numbers``: key -> number."""
    body = F.coalesce(c, F.lit(""))
    keys = F.regexp_extract_all(body, F.lit(r"""tables\[\s*["']([A-Za-z_]+)["']\s*\]"""), F.lit(1))
    named = F.array_compact(F.array(*[F.when(body.rlike(rf"\b{alias}\b"), F.lit(key)) for alias, key in ALIASES.items()]))
    return by_number(F.concat(_mapped(F.concat(keys, named), numbers), F.regexp_extract_all(body, F.lit(TABLE), F.lit(1))))


def clauses(df: DataFrame, doc: str, place: list[str], column: str) -> DataFrame:
    """(doc, number, body, section, relevant) of each paragraph that is a clause, under the last section before it in its document.

    Paragraphs that are neither, and null ones, are left out; a document's paragraphs meet in one task.
    """
    t = F.trim(F.col(column))
    rows = df.select(doc, *place, t.alias("_t"), t.rlike(CLAUSE).alias("_c"))
    section = F.when(~F.col("_c") & F.col("_t").rlike(SECTION), F.struct(F.regexp_extract("_t", SECTION, 1).alias("no"), F.regexp_extract("_t", SECTION, 2).alias("title")))
    w = Window.partitionBy(doc).orderBy(*place, "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_s", F.last(section, ignorenulls=True).over(w)).where("_c")
    title = F.coalesce(F.col("_s.title"), F.lit("Без раздела"))
    off = F.lit(False)
    for stem in OFF_TOPIC:
        off = off | F.lower(title).contains(stem)
    return found.select(doc, F.regexp_extract("_t", CLAUSE, 1).alias("number"), F.trim(F.regexp_extract("_t", CLAUSE, 2)).alias("body"), F.concat(F.coalesce(F.col("_s.no"), F.lit("0")), F.lit(". "), title).alias("section"), (~off).alias("relevant"))


def heads(df: DataFrame, doc: str, place: str, column: str, most: int = 12) -> DataFrame:
    """(doc, number, code, title, stage): the number stands in the first ``most`` paragraphs, the title in any; both fall back to the document's name."""
    rows = df.select(doc, place, F.trim(F.col(column)).alias("_t")).where("_t <> ''").withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(place, "_t")))
    paragraph = F.struct("_r", "_t")
    own = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("_r") <= most, paragraph))).alias("_head"), F.min(F.when(F.col("_t").startswith("Технологический регламент"), paragraph)).alias("_title"))
    name = F.col(doc).cast("string")
    found = F.regexp_extract(F.array_join(F.transform("_head", lambda p: p["_t"]), "\n"), r"Номер документа:\s*([^.]+)\.", 1)
    number = F.when(found == "", name).otherwise(F.trim(found))
    title = F.coalesce(F.col("_title._t"), name)
    one = own.select(doc, number.alias("number"), title.alias("title"))
    marker = F.lower(F.regexp_extract("title", r"(?U)Этап\s+(\w+)", 1))
    stage = F.lit("")
    for word, s in TITLE_STAGES.items():
        stage = F.when(marker == word, s).otherwise(stage)
    return one.select(doc, "number", F.split("number", "-20")[0].alias("code"), "title", stage.alias("stage"))
