"""Roles, directions, confidences and difference keys as columns (FN-50 to FN-64, AGG-29)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .text import norm_no, norm_text


def any_of(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def text_map(values: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def infer_role(file_role: Column, document_type: Column, filename: Column) -> Column:
    """FN-50: the stated role, else by keywords of type and file name; a statement of accounts is 'other'."""
    stated = text_map(config.EXPLICIT_ROLES, F.lower(F.trim(F.coalesce(file_role, F.lit("")))))
    text = F.lower(F.concat_ws(" ", F.coalesce(document_type, F.lit("")), F.coalesce(filename, F.lit(""))))
    found = F.when(F.contains(text, F.lit("对账")) & ~F.contains(text, F.lit("结算单")), F.lit("other"))
    for role, words in config.ROLE_KEYWORDS:
        found = found.when(any_of(text, words), F.lit(role))
    return F.coalesce(stated, found.otherwise(F.lit("other")))


def infer_direction(file_role: Column, contract_no: Column, up: list[str] = config.UP_PREFIXES, down: list[str] = config.DOWN_PREFIXES) -> Column:
    """FN-51."""
    role, no = F.lower(F.trim(F.coalesce(file_role, F.lit("")))), norm_no(contract_no)
    return (
        F.when(role == "contract_up", F.lit("up"))
        .when(role == "contract_down", F.lit("down"))
        .when(no.rlike(f"^({'|'.join(up)})"), F.lit("up"))
        .when(no.rlike(f"^({'|'.join(down)})"), F.lit("down"))
        .otherwise(F.lit("unknown"))
    )


def infer_nature(filename: Column, summary: Column, document_type: Column) -> Column:
    """FN-52: deposit before refund before payment."""
    text = norm_text(F.concat_ws(" ", filename, summary, document_type))
    return F.when(any_of(text, config.DEPOSIT_WORDS), F.lit("deposit")).when(any_of(text, config.REFUND_WORDS), F.lit("refund")).otherwise(F.lit("payment"))


#: How a cargo document names the receiver.
RECEIVERS = [
    r"公司名称[:：]\s*([^，。；\n]{2,40}?(?:有限公司|有限责任公司|股份有限公司))",
    r"转移给[下列]*[“\"'《]?([^”\"'《，。；\n]{2,40}?(?:有限公司|有限责任公司|股份有限公司))",
]


def cargo_receiver(text: Column) -> Column:
    """FN-53: the company to which the cargo passes, or ''."""
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in RECEIVERS], F.lit(""))


def file_role(document_type: Column) -> Column:
    """FN-54."""
    return F.coalesce(text_map(config.TYPE_ROLES, F.trim(document_type)), F.lit("other"))


def rule_confidence(n: Column, score: Column, priority_hits: Column) -> Column:
    """FN-60, in decimals so that rounding is exact."""
    d = lambda c: c.cast("decimal(20,6)")
    base = F.when(n == 1, d(F.lit("0.6"))).when(n == 2, d(F.lit("0.75"))).when(n == 3, d(F.lit("0.85"))).otherwise(F.least(d(F.lit("0.95")), d(F.lit("0.85")) + d(n - 3) * F.lit("0.03").cast("decimal(4,2)")))
    weight = F.least(d(F.lit("0.05")), F.greatest(d(F.lit(0)), (d(score) - d(n)) * F.lit("0.02").cast("decimal(4,2)")))
    hits = d(F.least(F.lit(2), F.greatest(F.lit(0), priority_hits))) * F.lit("0.04").cast("decimal(4,2)")
    return F.when(n > 0, F.round(F.least(d(F.lit("0.98")), base + weight + hits), 4)).otherwise(F.lit(0)).cast("decimal(6,4)")


def fused(sources: dict[str, Column], weights: dict[str, float] = config.WEIGHTS) -> Column:
    """AGG-29: the weighted mean of the sources that aren't null, each clamped to 0..1; 0 if there is none.  Sources count to eight
    decimals, weights to two, and the quotient is rounded half up to four, in whole numbers."""
    zero = F.lit(0).cast("long")
    scaled = {k: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double"))) * 1e8).cast("long") for k, c in sources.items()}
    weight = {k: F.lit(round(100 * weights[k])).cast("long") for k in sources}
    total = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), weight[k]).otherwise(zero) for k, c in sources.items()])
    value = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), scaled[k] * weight[k]).otherwise(zero) for k, c in sources.items()])
    quotient = F.call_function("div", value * 2 + total * 10_000, total * 20_000)  # in ten-thousandths
    return F.when(total > 0, (quotient.cast("decimal(10,0)") / F.lit(10_000).cast("decimal(5,0)"))).otherwise(F.lit(0)).cast("decimal(6,4)")


def decide(score: Column, auto: float = config.AUTO, review: float = config.REVIEW) -> Column:
    """FN-61."""
    return F.when(score >= auto, F.lit("auto")).when(score >= review, F.lit("review")).otherwise(F.lit("reject"))


def keyword_confidence(n: Column) -> Column:
    """FN-61."""
    return F.least(F.lit(1.0), n / 5.0)


def suggested_type(rule_type: Column, ai_type: Column, ai_conf: Column, least: float = config.AI_OVERRIDE, other: str = config.OTHER_TYPE) -> Column:
    """FN-62: the model's type if it is sure and isn't 'other', else the rules', else the model's."""
    sure = (ai_conf >= least) & (ai_type != other) & (ai_type != "")
    return F.when(sure, ai_type).otherwise(F.coalesce(F.nullif(rule_type, F.lit("")), ai_type, F.lit(other)))


def diff_key(kind: Column, direction: Column, role: Column, expected: Column, actual: Column, document_ids: Column) -> Column:
    """FN-59: twelve hex digits that name a difference across runs."""
    ids = F.array_join(F.transform(F.array_sort(document_ids), lambda i: i.cast("string")), ",")
    parts = [F.coalesce(c, F.lit("")) for c in (kind, direction, role, expected, actual)]
    return F.substring(F.sha1(F.concat_ws("|", *parts, F.coalesce(ids, F.lit(""))).cast("binary")), 1, 12)


def archive_path(segments: list[Column]) -> Column:
    """FN-64: a directory from segments; those that are null or empty are left out."""
    return F.concat_ws("/", *[F.nullif(F.trim(s.cast("string")), F.lit("")) for s in segments])
