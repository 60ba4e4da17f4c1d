"""Keys, names and text cleaning as columns (FN-01 to FN-39).  Everything stays in the JVM: no Python UDF.

Java's \\s and \\d know ASCII alone, so patterns that must see other spaces say (?U).  Scoped rewrites (commas within
an amount, zero padding within a date) mark what they found with two control characters, rewrite between the marks, and
take the marks away.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

def _compatible() -> dict[str, str]:
    """The characters of the basic plane that NFKC writes otherwise."""
    return {c: n for c in map(chr, range(0xA0, 0x10000)) if not "\ud800" <= c <= "\udfff" and (n := unicodedata.normalize("NFKC", c)) != c}


COMPATIBLE = _compatible()
#: Those that become one character, and the characters of keys that become several.
ONE = {c: n for c, n in COMPATIBLE.items() if len(n) == 1}
SEVERAL = {c: n for c, n in COMPATIBLE.items() if len(n) > 1 and re.fullmatch(r"[A-Za-z0-9.()/]+", n)}
CJK = r"\x{4e00}-\x{9fa5}"
A, B = "\u0001", "\u0002"
#: What (?U)\\s finds.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def norm_text(c: Column) -> Column:
    """FN-01: headers without white space, with ASCII parentheses, in lower case; null is ''."""
    return F.lower(F.translate(F.coalesce(c, F.lit("")), "（）" + SPACES, "()"))  # what has no counterpart goes


def norm_no(c: Column) -> Column:
    """FN-02: like norm_text but in upper case and without closing parentheses at the end."""
    bare = F.translate(F.coalesce(c, F.lit("")), "（）" + SPACES, "()")  # what has no counterpart goes
    return F.upper(F.rtrim(bare, F.lit(")")))


def contract_variants(c: Column) -> Column:
    """FN-03: the number and the number without parenthesised groups, as far as they aren't empty."""
    base = norm_no(c)
    bare = F.when(F.contains(base, F.lit("(")), F.regexp_replace(base, r"\([^)]*\)", "")).otherwise(base)
    return F.array_remove(F.array_distinct(F.array(base, bare)), "")


def compatible(c: Column) -> Column:
    """NFKC of full-width forms, circled and raised digits, units, ligatures and the like: characters that become one are
    translated, those that become several letters and digits are looked for only where a text holds one."""
    one = F.translate(c, "".join(ONE), "".join(ONE.values()))
    some = "[" + "".join(f"\\x{{{ord(x):x}}}" for x in SEVERAL) + "]"
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    letters = F.transform(F.split(one, ""), lambda x: F.coalesce(F.try_element_at(table, x), x))
    return F.when(one.rlike(some), F.array_join(letters, "")).otherwise(one)


def norm_column(c: Column) -> Column:
    """FN-04: a spreadsheet header."""
    return F.lower(F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), r"(?U)[\s()\[\]【】\-_/\\.:,;、]", ""))


def lookup_key(c: Column) -> Column:
    """FN-05."""
    return F.upper(F.regexp_replace(compatible(F.coalesce(c, F.lit(""))), r"(?U)\s", ""))


def cell_text(c: Column, kind: str) -> Column:
    """FN-08: a cell as text: days as yyyy-MM-dd, whole numbers without a fraction, other values trimmed; null is ''."""
    if kind in ("date", "timestamp"):
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind in ("double", "float"):
        out = F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))
    else:
        out = F.trim(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def norm_quantity(c: Column) -> Column:
    """FN-06."""
    return F.trim(F.translate(F.coalesce(c, F.lit("")), ",，", ""))


def alnum(c: Column) -> Column:
    """FN-07: letters and digits, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}\p{N}]", ""))


def business_no(c: Column) -> Column:
    """FN-09."""
    bare = F.regexp_replace(F.upper(compatible(F.coalesce(c, F.lit("")))), r"(?U)[\s_]+", "")
    return F.regexp_replace(bare, "-+", "-")


def is_business_no(c: Column, prefixes: list[str] = config.BUSINESS_PREFIXES) -> Column:
    """FN-10: a known prefix, then 202 somewhere (which is a digit as well)."""
    return business_no(c).rlike(f"(?s)^({'|'.join(prefixes)}).*202")


def no_from_filename(c: Column) -> Column:
    """FN-11: a valid business number in a file name, or ''."""
    found = F.regexp_extract(
        F.coalesce(c, F.lit("")), r"(?i)[A-Z]{2,10}(?:（DD）|\(DD\)|[-_])?[-_/]?\d{4}[-_/]?[A-Z]{0,6}\d{2,}|[A-Z]{2,6}\d{4,}", 0
    )
    return F.when(is_business_no(found), found).otherwise(F.lit(""))


def name_core(c: Column, noise: list[str] = config.NAME_NOISE) -> Column:
    """FN-12: a company's name without parentheses and the usual words, taken away in order."""
    core = F.regexp_replace(norm_text(c), r"\([^)]*\)", "")
    for word in noise:
        core = F.replace(core, F.lit(word), F.lit(""))
    return core


def name_match(a: Column, b: Column) -> Column:
    """FN-12: whether one core holds the other; empty cores match nothing."""
    x, y = name_core(a), name_core(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x))


def norm_company(c: Column) -> Column:
    """FN-13."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s，,。；;：:（）()\-_/]", "")


def norm_type(c: Column) -> Column:
    """FN-15."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""))


def content_hash(c: Column) -> Column:
    """FN-16: sixteen hex digits of the text without white space, or '' if nothing is left."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    return F.when(bare == "", F.lit("")).otherwise(F.substring(F.sha2(bare, 256), 1, 16))


def chars_differ(a: Column, b: Column) -> Column:
    """FN-18: places where two strings of one length differ, or null for other lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.char_length(a) == F.char_length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def safe_filename(stem: Column, extension: Column | None = None, most: int = 120) -> Column:
    """FN-20: without characters that file systems refuse, white space as _, no dots or _ at the ends."""
    name = F.regexp_replace(F.coalesce(stem, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "")
    name = F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", "_"), r"^[._ ]+|[._ ]+$", "")
    name = F.when(name.rlike(r"(?i)^(con|prn|aux|nul|com\d|lpt\d)$"), F.concat(name, F.lit("_"))).otherwise(name)
    name = F.when(name == "", F.lit("unnamed")).otherwise(F.substring(name, 1, most))
    if extension is None:
        return name
    ext = F.regexp_replace(F.lower(F.coalesce(extension, F.lit(""))), r"[^a-z0-9]", "")
    return F.when(ext == "", name).otherwise(F.concat(name, F.lit("."), F.substring(ext, 1, 10)))


def is_safe_path(c: Column) -> Column:
    """FN-22: a relative path that stays below its root."""
    return ~(c.rlike(r"^[/\\]|^[A-Za-z]:") | c.rlike(r"(^|[/\\])\.\.([/\\]|$)"))


def head_and_tail(c: Column, most: int = 1500, mark: str = "\n…\n") -> Column:
    """FN-23: the first two thirds and the last third of the room, if the text is longer."""
    head = most * 2 // 3
    cut = F.concat(F.substring(c, 1, head), F.lit(mark), F.right(c, F.lit(most - head)))
    return F.when(F.char_length(c) > most, cut).otherwise(c)


# Text cleaning


def normal_lines(c: Column) -> Column:
    """FN-30: \\n alone, and at most one empty line in a row."""
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n{3,}", "\n\n")


def normal_spaces(c: Column) -> Column:
    """FN-30: white space of a line is one space; single spaces, which most are, are not rewritten."""
    return F.regexp_replace(F.replace(c, F.lit("　"), F.lit(" ")), r"[ \t]{2,}|\t", " ")


def fold_repeats(c: Column) -> Column:
    """FN-30: a character more than three times in a row stays three times."""
    return F.regexp_replace(c, r"(?U)(\S)\1{3,}", "$1$1$1")


def padded_dates(c: Column, pattern: str, day: bool = True) -> Column:
    """Writes what the pattern's groups (year, month, day) find as yyyy-MM-dd."""
    marked = F.regexp_replace(c, pattern, f"{A}$1-0$2-0$3{B}" if day else f"{A}$1-0$2{B}")
    if day:
        return F.regexp_replace(marked, rf"{A}(\d{{4}})-0?(\d{{2}})-0?(\d{{2}}){B}", "$1-$2-$3")
    return F.regexp_replace(marked, rf"{A}(\d{{4}})-0?(\d{{2}}){B}", "$1-$2")


def normal_dates(c: Column) -> Column:
    """FN-31."""
    c = padded_dates(c, r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日")
    c = padded_dates(c, r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})")
    return padded_dates(c, r"(\d{4})年(\d{1,2})月", day=False)


def normal_amounts(c: Column) -> Column:
    """FN-32: amounts next to a currency sign or 元 lose sign, unit and commas."""
    for pattern in (r"(?U)(?:人民币|RMB|¥|￥)\s*([\d,]+(?:\.\d{1,2})?)\s*元?", r"(?U)([\d,]+\.\d{1,2})\s*元", r"(?U)([\d,]+)\s*元"):
        marked = F.regexp_replace(c, pattern, f"{A}$1{B}")
        c = F.translate(F.regexp_replace(marked, rf",(?=[\d,.]*{B})", ""), A + B, "")
    return c


def clean_text(c: Column) -> Column:
    """FN-33: the whole cleaning; null is ''.  Dates and amounts are looked for only in texts that hold what every one of their
    patterns needs (or a mark), which lines, spaces and repeats can't bring in."""
    c = F.coalesce(c, F.lit(""))
    folded = fold_repeats(normal_spaces(normal_lines(c)))
    some = c.rlike(r"\d{4}[-/.]\d")
    for sign in ("年", "元", "¥", "￥", "人民币", "RMB", A, B):
        some = some | F.contains(c, F.lit(sign))
    return F.trim(F.when(some, normal_amounts(normal_dates(folded))).otherwise(folded), F.lit(SPACES))


def clean_tables(tables: Column) -> Column:
    """FN-33 for the cells of array<array<array<string>>>."""
    return F.transform(tables, lambda t: F.transform(t, lambda r: F.transform(r, clean_text)))


def join_vertical(c: Column) -> Column:
    """FN-34: lines of one CJK character each, one below the other, become one line."""
    alone = F.regexp_replace(c, rf"(?m)^[ \t]*([{CJK}])[ \t]*$", "$1")
    return F.regexp_replace(alone, rf"(?m)^([{CJK}])\n(?=[{CJK}]$)", "$1")


#: Lines that are page numbers, and words that head watermarks.
PAGE_LINE = r"(?U)^\s*(?:第\s*\d+\s*页|页\s*\d+|[-–—]?\s*\d+\s*/\s*\d+\s*[-–—]?|\d{1,3}|[-–—]\s*\d+\s*[-–—])\s*$"
EDGE_LINE = r"(?U)^\s*\d{4,5}\s*$"
WATERMARK = r"(?Uis)^(仅供参考|仅供\s*内部参考|内部参考|内部资料|机密|秘密|草稿|DRAFT|CONFIDENTIAL|Copy|Page|页)\s*.{0,30}$"


def clean_ocr(c: Column) -> Column:
    """FN-35: vertical lines joined; page numbers, short numbers within three lines of either end, watermarks, empty
    lines and control characters dropped."""
    lines = F.split(F.regexp_replace(join_vertical(F.coalesce(c, F.lit(""))), r"\r\n?", "\n"), "\n")

    def stays(line: Column, i: Column) -> Column:
        own = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        edge = (i < 3) | (i >= F.size(lines) - 3)
        return (own != "") & ~own.rlike(PAGE_LINE) & ~(edge & own.rlike(EDGE_LINE)) & ~own.rlike(WATERMARK)

    text = F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


LIKE = "".join(config.DIGIT_LIKE)
#: The letters of each digit.
LETTERS = {"".join(k for k, v in config.DIGIT_LIKE.items() if v == digit): digit for digit in config.DIGIT_LIKE.values()}


def as_digits(c: Column, before: str, after: str = "") -> Column:
    """The letters that stand for digits between two patterns, as digits.  One pass marks them all, and marked letters are plain text to
    replace.  What stands before is looked at once a letter is found: such a look tries each length, and would do so at every place."""
    c = F.regexp_replace(c, f"[{LIKE}]{after}(?<={before}.)", f"{A}{B}$0")
    for letter, digit in config.DIGIT_LIKE.items():
        c = F.replace(c, F.lit(A + B + letter), F.lit(digit))
    return c


def repair_digits(c: Column) -> Column:
    """FN-36: letters that stand for digits, between digits or after a currency sign.  White space after the sign
    goes.  The sign stays once, as documented (the original's code doubles it)."""
    after = rf"(?=[{LIKE}]{{0,40}}\d)"
    one = as_digits(c, rf"\d[{LIKE}]{{0,40}}", after)
    # In longer runs a letter may be near to a digit only once another has become one.
    each = c
    for letters, digit in LETTERS.items():
        each = F.regexp_replace(each, rf"[{letters}]{after}(?<=\d[{LIKE}]{{0,40}}.)", digit)
    c = F.when(c.rlike(f"[{LIKE}]{{42}}"), each).otherwise(one)
    c = F.regexp_replace(c, rf"(?<=[¥￥])[ \t]+(?=[{LIKE}\d])", "")
    return as_digits(c, rf"[¥￥][{LIKE}\d]{{0,40}}")


def unify_dates(c: Column) -> Column:
    """FN-37: Chinese, separated, short-year and compact dates as yyyy-MM-dd."""
    c = padded_dates(c, r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?")
    c = padded_dates(c, r"(?<!\d)(\d{4})[-/.年]\s*(\d{1,2})[-/.月]\s*(\d{1,2})日?(?!\d)")
    for digits, century in ((3, "2"), (2, "20")):
        marked = F.regexp_replace(c, rf"(?<![\d])(?<!\d-)(\d{{{digits}}})[-/.月]\s*(\d{{1,2}})[-/.月]\s*(\d{{1,2}})日?(?!\d)", f"{A}{century}$1-0$2-0$3{B}")
        c = F.regexp_replace(marked, rf"{A}(\d{{4}})-0?(\d{{2}})-0?(\d{{2}}){B}", "$1-$2-$3")
    return F.regexp_replace(c, r"(?<!\d)(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)", "$1-$2-$3")


def repair_invoice_no(c: Column) -> Column:
    """FN-38: letters that stand for digits in an invoice number or code."""
    label = r"(?:发票号码|发票号|发票代码|代码)[:：]?[ \t]{0,8}"
    return as_digits(c, rf"{label}[0-9A-Za-z\-_/]{{0,30}}")


def invoice_length_ok(c: Column) -> Column:
    """FN-38: whether a number has one of the lengths of invoice numbers."""
    return F.char_length(F.regexp_replace(c, r"\D", "")).isin(config.INVOICE_LENGTHS)


def clean_scan(c: Column) -> Column:
    """FN-39: a struct of the repaired text and the corrections (kind, original) that led to it."""
    c = F.coalesce(c, F.lit(""))
    digits = repair_digits(c)
    dates = unify_dates(digits)
    text = repair_invoice_no(dates)
    numbers = F.regexp_extract_all(c, F.lit(rf"(?<=\d)[{LIKE}]+(?=\d)"), F.lit(0))
    days = F.regexp_extract_all(digits, F.lit(r"\d{4}\s*[年/.]\s*\d{1,2}\s*[月/.]\s*\d{1,2}日?"), F.lit(0))
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("original"))
    return F.struct(text.alias("text"), F.concat(F.transform(numbers, entry("number")), F.transform(days, entry("date"))).alias("corrections"))
