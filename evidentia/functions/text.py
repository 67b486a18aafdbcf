"""Text functions as column expressions: keys, tokens, locators, citations, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters and a digit, and the Cyrillic letters that look like them (fixed values). Both cases are mapped.
LATIN, CYRILLIC = "ABCEHKMOPTXYIabcehkmoptxyi3", "АВСЕНКМОРТХУІавсенкмортхуіз"
TOKEN = r"[\p{L}\p{N}]+(?:[-.][\p{L}\p{N}]+)*"


def normalize_key(c: Column) -> Column:
    """Look-alike letters as one, lower case, single spaces. ``lower`` stands for case folding; NFKC is left to ingestion."""
    return F.lower(F.translate(F.trim(F.regexp_replace(c, r"\s+", " ")), LATIN, CYRILLIC))


def tokenize(c: Column) -> Column:
    """Lower-case words; the parts of compounds with ``-`` or ``.`` follow after all of them."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def whole(t: Column) -> Column:
        compounds = F.array_join(F.filter(t, lambda x: x.contains("-") | x.contains(".")), " ")
        return F.when(compounds == "", t).otherwise(F.concat(t, F.split(compounds, "[-. ]")))

    return F.transform(F.array(tokens), whole)[0]  # a name for the tokens, which are found once


#: Endings of Cyrillic words (fixed values).
SUFFIXES = (
    "иями", "ями", "ами", "ией", "иям", "ыми", "ими", "ого", "его", "ому", "ему", "ешь", "ете", "ившись", "вшись", "ется", "ются",
    "ая", "яя", "ые", "ие", "ый", "ий", "ой", "ей", "ом", "ем", "ах", "ях", "ов", "ев", "ью", "ия", "ии", "ую", "юю", "ет", "ут", "ют", "ат", "ят",
    "ла", "ло", "ли", "на", "но", "ны", "ть", "ти", "ся", "сь", "а", "я", "ы", "и", "е", "о", "у", "ю", "ь", "й",
)
#: Three characters or more, as few as possible, before an ending: so the longest ending goes.
STEM = "^(.{3,}?)(?:" + "|".join(SUFFIXES) + ")$"


def _tree(endings: list[str]) -> str:
    """A pattern of these texts in which those that begin alike share a branch."""
    rest = {k: sorted(x[1:] for x in endings if x[:1] == k) for k in sorted({x[:1] for x in endings if x})}
    arms = [k + (_tree(v) if v != [""] else "") for k, v in rest.items()]
    return f"(?:{'|'.join(arms)}){'?' if '' in endings else ''}"


#: STEM with fewer branches to try at each place.
_ENDING = f"^(.{{3,}}?){_tree(sorted(SUFFIXES))}$"


def stem(c: Column) -> Column:
    """Words with a Cyrillic letter without their ending, taken off twice; other words as they are, as endings are Cyrillic."""
    return F.regexp_replace(F.regexp_replace(c, _ENDING, "$1"), _ENDING, "$1")


def terms(c: Column) -> Column:
    return F.transform(tokenize(c), stem)


def distinct_terms(c: Column) -> Column:
    """Each term once; equal words are stemmed once."""
    return F.array_distinct(F.transform(F.array_distinct(tokenize(c)), stem))


def code_points(c: Column) -> Column:
    """Each character with its code point, as ``A U+0041``."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.concat(x, F.lit(" U+"), F.lpad(F.hex(F.ascii(x)), 4, "0")))


def code_key(c: Column) -> Column:
    """Identifiers without case, underscores and spaces."""
    return F.regexp_replace(F.lower(c), "[_ ]", "")


#: Stages and the parts of words that tell them (fixed values), the first one first.
STAGES = (("экструзия", "экструз"), ("печать", "печат"), ("кольцевание", "кольцев"))


def stage(c: Column) -> Column:
    low, out = F.lower(c), F.lit(None).cast("string")
    for name, marker in reversed(STAGES):
        out = F.when(low.contains(marker), name).otherwise(out)
    return out


def short(c: Column, most: int = 160) -> Column:
    """At most ``most`` characters, single spaces, and a mark where some are cut."""
    one = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.substring(one, 1, most), F.lit("…")))


def items(c: Column, separator: str = ";") -> Column:
    """Parts between separators, trimmed, without blanks; none of null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda x: F.trim(x)), lambda x: x != "")


def number(c: Column) -> Column:
    """Text as a number, also with a decimal comma; null where it is none."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def term_index(c: Column, bits: int = 20) -> Column:
    return F.crc32(F.encode(c, "UTF-8")) % (1 << bits)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; 99 where lengths differ by more than 3."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 3, 99).otherwise(F.levenshtein(a, b))


def locator(source: str, row: Column) -> Column:
    return F.concat(F.lit(f"{source}, row "), row.cast("string"))


#: A locator of one row whose head is in lower case with single spaces, as most are: its parts stand at known places. Other patterns cost many times as much.
PLAIN = r"^[a-zа-яё]++(?: [a-zа-яё]++)*+, row [0-9]{1,18}\z"


def locator_head(c: Column) -> Column:
    """What stands before the rows, lower-case, with single spaces."""
    head = F.trim(F.regexp_replace(F.lower(F.regexp_extract(c, r"^(.*?)(?:,?\s*rows?\s+\d.*)?$", 1)), r"\s+", " "))
    return F.when(c.rlike(PLAIN), F.substring_index(c, ",", 1)).otherwise(head)


def locator_rows(c: Column) -> Column:
    rows = F.transform(F.regexp_extract_all(F.regexp_extract(c, r"rows?\s+(\d.*)$", 1), F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("long"))
    return F.when(c.rlike(PLAIN), F.array(F.substring_index(c, " ", -1).cast("long"))).otherwise(rows)


def citations(c: Column) -> Column:
    """Bracketed texts of 3 to 300 characters, trimmed, without blanks, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([^\[\]]{3,300})\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def redact(c: Column) -> Column:
    """Bearer tokens and keys that start with sk- are masked."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)bearer\s+[a-z0-9._-]+", "Bearer ***"), r"sk-[A-Za-z0-9_-]{8,}", "sk-***")
