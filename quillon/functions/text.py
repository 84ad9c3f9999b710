"""Column builders for text normalisation, numbers, tokens and facts. All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character: letters, numbers, underscore of any script (Java's own class is ASCII).
WORD = r"[\p{L}\p{N}_]"
RUN = WORD + "+"
RUNS = rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"
TOKEN = rf"({WORD}(?:[\p{{L}}\p{{N}}_-]*{WORD})?)"
# The letters of fact tokens, both cases, with those that fold to one of them; a token is
# letters, digits of any script, then letters, plain digits and hyphens; or one of two signs.
LETTERS = "a-zA-Zа-яА-ЯıİſKᲀ-ᲆ"
# What lies between tokens is passed over in long strides (group 1 is '' there), since trying a token at each letter of
# each word costs several times as much. Letters that no digit follows begin no token, wherever in them one starts.
_BETWEEN = rf"(?:[{LETTERS}]++(?!\p{{Nd}})|[^{LETTERS}\p{{Nd}}%₽]++){{1,64}}+"
FACT = rf"{_BETWEEN}|([{LETTERS}]*+\p{{Nd}}++[{LETTERS}0-9-]*+|[%₽])"
DECIMAL_FACT = rf"{_BETWEEN}|(\p{{Nd}}++[.,]\p{{Nd}}++|[{LETTERS}]*+\p{{Nd}}++[{LETTERS}0-9-]*+|[%₽])"
NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"



def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """Lower-case letters whose case folding is another letter, and those whose folding is several."""
    one, many = {}, {}
    for c in map(chr, range(0x80, 0x1F000)):
        low, folded = c.lower(), c.casefold()
        if len(low) == 1 and folded != low:
            (one if len(folded) == 1 else many)[low] = folded
    return one, many


def _ranges(letters, gap: int = 8) -> str:
    """A pattern of few ranges that hold the letters, for a quick search: long lists of letters are slow to match."""
    codes, ranges = sorted(map(ord, letters)), []
    for c in codes:
        if ranges and c - ranges[-1][1] <= gap:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


FOLD_ONE, FOLD_MANY = _foldings()
#: Signs that count as digits beside decimal ones: superscripts, circled digits and the like.
OTHER_DIGITS = "".join(c for c in map(chr, range(0x80, 0x1F200)) if c.isdigit() and not c.isdecimal())

# Words that are never reported as newly introduced.
FUNCTION_WORDS = ("а", "без", "в", "во", "для", "до", "за", "и", "из", "или", "к", "как", "на", "над", "но", "о", "об", "от", "по", "под", "при", "про", "с", "со", "у")


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _folded(x, one: dict[str, str]) -> Column:
    """Lower case with letters mapped; texts without such letters, most of all, are only searched for them."""
    low = F.lower(_column(x))
    beyond = F.rlike(low, F.lit(r"[\xB5\x{130}-\x{10FFFF}]"))  # beside sharp s, nothing below folds otherwise
    mapped = F.when(beyond & F.rlike(low, F.lit(_ranges(one))), F.translate(low, "".join(one), "".join(one.values()))).otherwise(low)
    common = F.replace(mapped, F.lit("ß"), F.lit("ss"))
    rare = {k: v for k, v in FOLD_MANY.items() if k != "ß"}
    table = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in rare.items()) + ")")  # one call for all entries
    spelled = F.array_join(F.transform(F.regexp_extract_all(common, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(beyond & F.rlike(common, F.lit(_ranges(rare))), spelled).otherwise(common)


def casefold(x) -> Column:
    """Full case folding; null stays null."""
    return _folded(x, FOLD_ONE)


def normalize(x) -> Column:
    """Case-folded text with U+0451 as U+0435; null is ''."""
    return F.coalesce(_folded(x, {**FOLD_ONE, "ё": "е"}), F.lit(""))


def strip(x) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(_column(x), r"(?U)^\s+|\s+$", "")


def normalize_header(x) -> Column:
    return F.trim(F.regexp_replace(normalize(x), r"(?U)\s+", " "))


def cell(value, is_number) -> Column:
    """A table cell as text: numbers equal to zero are blank, as null is."""
    v = _column(value)
    zero = _column(is_number) & (F.expr("try_cast(NULL AS DOUBLE)") if v is None else v.try_cast("double") == 0)
    return F.when(F.coalesce(zero, F.lit(False)), F.lit("")).otherwise(F.coalesce(v, F.lit("")))


def number(x) -> Column:
    """A number from text: white space off, comma as point, underscores between digits; else null. NaN and infinity are null."""
    t = F.replace(strip(F.coalesce(_column(x).cast("string"), F.lit(""))), F.lit(","), F.lit("."))
    plain = F.replace(t, F.lit("_"), F.lit("")).try_cast("double")
    return F.when(F.rlike(t, F.lit(NUMBER)) & (F.abs(plain) < F.lit(float("inf"))), plain)


def clean_number(x) -> Column:
    """A number as text: whole numbers without a point."""
    x = _column(x)
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(x.cast("string"))


def relation_key(x) -> Column:
    n = number(x)
    return F.when(n.isNotNull(), clean_number(n)).otherwise(normalize_header(x))


def split_forms(x) -> Column:
    """Items between commas, semicolons and line ends, stripped, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_column(x), F.lit("")), r"[,;\r\n]+"), strip), lambda t: t != "")


def tokens(normalized) -> Column:
    return F.regexp_extract_all(_column(normalized), F.lit(TOKEN), F.lit(1))


def runs(normalized) -> Column:
    return F.regexp_extract_all(_column(normalized), F.lit(RUN), F.lit(0))


def all_runs(normalized) -> Column:
    """Word runs and the runs between them, in order: joined they are the text."""
    return F.regexp_extract_all(_column(normalized), F.lit(RUNS), F.lit(0))


def bounded(form) -> Column:
    """A pattern that finds ``form`` where no word character touches it."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(_column(form), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E"))
    return F.concat(F.lit(rf"(?<!{WORD})"), quoted, F.lit(rf"(?!{WORD})"))


def fact_tokens(raw, decimal_aware: bool = False) -> Column:
    """Sorted distinct number-bearing tokens and the signs % and U+20BD: found in the raw text, then normalised."""
    found = F.regexp_extract_all(F.coalesce(_column(raw), F.lit("")), F.lit(DECIMAL_FACT if decimal_aware else FACT), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(F.array_remove(F.array_distinct(found), ""), lambda t: F.replace(normalize(t), F.lit(","), F.lit(".")))))


def letter_count(raw, letters: str = "Ёё") -> Column:
    return F.regexp_count(F.coalesce(_column(raw), F.lit("")), F.lit(f"[{letters}]")).cast("long")


def column_ordinal(reference) -> Column:
    """0-based column of a cell reference such as AA10; 0 without letters."""
    letters = F.upper(F.regexp_extract(_column(reference), r"^([A-Za-z]+)", 1))
    value = F.aggregate(F.filter(F.split(letters, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)
    return F.greatest(value - 1, F.lit(0))


def is_digits(x) -> Column:
    """Digits only: decimal ones of any script, and superscripts and their like."""
    return F.rlike(_column(x), F.lit(rf"^[\p{{Nd}}{OTHER_DIGITS}]+$"))


# Kinds of tasks that are simple up to the simple length, whatever else is said of them.
NARROW = ("rewrite", "proofreading", "translation", "title", "caption")


def route_by_length(n_chars, simple: int = 2500, complex_: int = 6000, kind=None, quality_first=None, asked=None) -> Column:
    """Class of a request by its length, with what overrides it.

    ``asked``: a class named by the user wins. ``quality_first``: a wish for the best quality, whatever the cost,
    makes it complex. ``kind``: a narrow task is simple unless it is long, a short one of another kind is standard.
    """
    n = _column(n_chars)
    by_length = F.when(n <= simple, "simple").when(n > complex_, "complex").otherwise("standard")
    if kind is not None:
        narrow = F.coalesce(_column(kind).isin(*NARROW), F.lit(False))
        by_length = F.when(n > complex_, "complex").when(narrow, "simple").when(_column(kind).isNotNull(), "standard").otherwise(by_length)
    if quality_first is not None:
        by_length = F.when(F.coalesce(_column(quality_first), F.lit(False)), "complex").otherwise(by_length)
    return by_length if asked is None else F.coalesce(_column(asked), by_length)
