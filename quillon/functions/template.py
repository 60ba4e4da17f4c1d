"""File-name templates, compiled on the driver into one column (FN-84, FN-85, UDF-03).

    {name}  {name:function}  {name|function|function}      the field, or nothing if it is missing
    {{IF name}}…{{ELSE}}…{{END}}   {{IF name == value}}   {{IF name != value}}      may be nested

Functions: compact, cn, int, round, short, upper, lower, also with the prefixes date:, amount:, company:.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import safe_filename

TAG = re.compile(r"\{\{\s*(IF\s+.+?|ELSE|END)\s*\}\}|\{([^{}]+)\}")
#: Endings that a short company name goes without, and texts that count as missing.
ENDINGS = "(股份有限公司|有限责任公司|集团有限公司|科技有限公司|有限公司|公司|集团|工厂|商行|事务所|合作社|医院|学校)$"
MISSING = ["", "null", "None", "undefined"]


def value_of(name: str, fields: dict[str, Column]) -> Column:
    """The first field by the name's aliases that isn't missing, else ''."""
    keys = [k for k in [*config.TEMPLATE_NAMES.get(name, [name]), name] if k in fields]
    own = [F.when(~fields[k].cast("string").isin(MISSING), F.trim(fields[k].cast("string"))) for k in keys]
    return F.coalesce(*own, F.lit(""))


def applied(function: str, value: Column) -> Column:
    name = function.strip().rpartition(":")[2]
    number = F.regexp_extract(value, r"\d+(?:\.\d+)?", 0)
    if name == "compact":
        return F.regexp_replace(value, "[-/.]", "")
    if name == "cn":
        parts = [F.regexp_extract(value, r"^(\d{4})-(\d{1,2})-(\d{1,2})", g) for g in (1, 2, 3)]
        return F.when(parts[0] != "", F.concat(parts[0], F.lit("年"), F.lpad(parts[1], 2, "0"), F.lit("月"), F.lpad(parts[2], 2, "0"), F.lit("日"))).otherwise(value)
    if name == "int":
        return F.when(number != "", F.floor(number.try_cast("decimal(30,6)")).cast("string")).otherwise(value)
    if name == "round":
        return F.when(number != "", F.bround(number.try_cast("decimal(30,6)"), 0).cast("decimal(30,0)").cast("string")).otherwise(value)
    if name == "short":
        short = F.regexp_replace(value, ENDINGS, "")
        return F.when(short == "", value).otherwise(short)
    if name in ("upper", "lower"):
        return getattr(F, name)(value)
    return value


def condition(text: str, fields: dict[str, Column]) -> Column:
    m = re.match(r"^(.+?)\s*(==|=|!=|<>)\s*(.+?)$", text.strip())
    if not m:
        return value_of(text.strip(), fields) != ""
    value = value_of(m[1].strip(), fields)
    return value == m[3].strip() if m[2] in ("==", "=") else value != m[3].strip()


def compiled(template: str, fields: dict[str, Column]) -> Column:
    """The template's text as a column; an unfinished block is an error."""
    stack: list[dict] = [{"parts": []}]
    at = 0
    for m in TAG.finditer(template):
        if m.start() > at:
            stack[-1]["parts"].append(F.lit(template[at : m.start()]))
        at = m.end()
        tag = m[1]
        if tag is None:
            first, *functions = [s.strip() for s in m[2].split("|")]
            name, colon, function = first.partition(":")
            value = value_of(name.strip(), fields)
            for f in ([function] if colon else []) + functions:
                value = F.when(value == "", value).otherwise(applied(f, value))
            stack[-1]["parts"].append(value)
        elif tag == "ELSE":
            stack[-1]["then"], stack[-1]["parts"] = stack[-1]["parts"], []
        elif tag == "END":
            if len(stack) == 1:
                raise ValueError("END without IF")
            block = stack.pop()
            then, other = (block["then"], block["parts"]) if "then" in block else (block["parts"], [])
            joined = lambda parts: F.concat(F.lit(""), *parts)
            stack[-1]["parts"].append(F.when(block["if"], joined(then)).otherwise(joined(other)))
        else:
            stack.append({"if": condition(tag[2:], fields), "parts": []})
    if len(stack) > 1:
        raise ValueError("IF without END")
    return F.concat(F.lit(""), *stack[0]["parts"], F.lit(template[at:]))


def rendered(template: str | None, fields: dict[str, Column], extension: Column | None = None) -> Column:
    """A safe file name: the text, with runs of _ and of blanks as one _, none at the ends."""
    text = F.regexp_replace(compiled(template or config.DEFAULT_TEMPLATE, fields), r"_+\s*_+|_{2,}|\s{2,}", "_")
    return safe_filename(F.btrim(text, F.lit("_ ")), extension)
