"""Reconciliation of business lines with their documents (section 2.13: binding, matrix, rules R1 to R7, status, closure).

A line of the ledger has an upstream and a downstream side.  Documents are bound to lines in one plan (H12), then each rule is
a join of lines with grouped documents that yields rows of DIFF; their union is the list of differences.

Decisions on quirks: bindings are copied for each line, so that what one line assigns doesn't leak into others (Q2), a cargo
document that its receiver has settled isn't assigned again (Q1), and a document pool is used for candidates only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.classify import cargo_receiver, diff_key
from ..functions.money import MONEY, amount_text
from ..functions.text import contract_variants, name_core, norm_text
from ..sources.shared import scratch, written
from .cluster import image_leaders
from .joins import containment_join, mentions, tolerance_join, variant_join

DIFF = ["business_no", "rule", "type", "severity", "direction", "role", "expected", "actual", "delta", "document_ids"]
TOL = config.TOLERANCE


def money(x: str = "0") -> Column:
    return F.lit(x).cast(MONEY)


def off(a: Column, b: Column) -> Column:
    """Whether two amounts differ by more than the tolerance; null if either is."""
    return F.abs(a - b) > money(TOL)


def diff(rows: DataFrame, rule: str, kind: str, severity: Column | str, direction: Column | str = "", role: Column | str = "",
         expected: Column | None = None, actual: Column | None = None, delta: Column | None = None, ids: Column | None = None) -> DataFrame:
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        "business_no", F.lit(rule).alias("rule"), F.lit(kind).alias("type"), c(severity).alias("severity"), c(direction).alias("direction"), c(role).alias("role"),
        (F.lit("") if expected is None else expected).alias("expected"), (F.lit("") if actual is None else actual).alias("actual"),
        (F.lit("") if delta is None else delta).alias("delta"), (F.array().cast("array<string>") if ids is None else ids).alias("document_ids"),
    )


# Anchors and binding


def anchor_list(lines: DataFrame) -> Column:
    """FN-55: the amounts by which a document can be known, in order, without those within the tolerance of an earlier one."""
    has = lambda c: F.col(c) if c in lines.columns else F.lit(None).cast(MONEY)
    every = [
        ("up", has("up_contract_amount")), ("up", has("up_settlement")), ("up", has("pay_amount")),
        ("down", has("down_contract_amount")), ("down", has("down_settlement")), ("down", has("receipt_amount")), ("down", has("interest_received")),
        ("down", has("receipt_amount") + has("interest_received")), ("down", has("down_settlement") + has("interest_received")),
    ]
    # Spelt out for each amount, as nested lambdas aren't compiled.
    known = [(k, d, a.cast(MONEY)) for k, (d, a) in enumerate(every)]
    good = lambda a: F.coalesce(a > 0, F.lit(False))
    near = lambda a, b: good(b) & F.coalesce(F.abs(b - a) <= money(TOL), F.lit(False))
    first = lambda k, a: reduce(lambda x, y: x & ~near(a, y), [b for j, _, b in known if j < k], good(a))
    rows = F.array(*[F.when(first(k, a), F.struct(F.lit(k).alias("rank"), F.lit(d).alias("direction"), a.alias("anchor"))) for k, d, a in known])
    return F.filter(rows, lambda r: r.isNotNull())


def anchors(lines: DataFrame) -> DataFrame:
    """A row for each anchor of each line."""
    return lines.select("business_no", F.inline(anchor_list(lines)))


def by_amount(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """JON-11: (document_id, business_no, direction) by the first anchor of the document's own line within the tolerance."""
    hits = docs.select("document_id", "amount", "business_no").join(lines.select("business_no", anchor_list(lines).alias("_a")), "business_no")
    near = F.array_min(F.transform(F.filter("_a", lambda a: F.abs(F.col("amount") - a["anchor"]) <= money(TOL)), lambda a: F.struct(a["rank"].alias("rank"), a["direction"].alias("direction"))))
    return hits.withColumn("_way", near).filter("_way IS NOT NULL").groupBy("document_id", "business_no").agg(F.min("_way")["direction"].alias("direction"))


def like(a: Column, b: Column) -> Column:
    """Whether of two names, neither empty, one holds the other."""
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def way(own: str, supplier: Column, customer: Column) -> Column:
    """(rank, direction) by names: seller is the supplier (up), company the customer (down), company the supplier (up), seller the
    customer (down), the first of them; null if none is."""
    ranks = {"seller": (0, 3), "company": (2, 1)}[own]
    one = lambda hit, rank, to: F.when(hit, F.struct(F.lit(rank).alias("rank"), F.lit(to).alias("direction")))
    return F.array_min(F.array(one(supplier, ranks[0], "up"), one(customer, ranks[1], "down")))


#: What is found of a document: the smallest and the largest line that fits, and the direction, which counts if they are the same.
#: So a document, and a name or an amount that many of them have, is one row, however many lines fit.
def reach(rows: DataFrame, key: str, direction: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(direction).alias("way"))


def amount_reach(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """JON-11: by the anchors of lines within the tolerance; equal amounts are looked up once."""
    hits = tolerance_join(anchors(lines), docs.select("amount").distinct(), "anchor", "amount", TOL)
    own = hits.select("amount", F.col("business_no").alias("lo"), F.col("business_no").alias("hi"), "rank", "direction")
    return docs.select("document_id", "amount").join(reach(own, "amount", F.struct("rank", "direction")), "amount").drop("amount")


def party_reach(docs: DataFrame, lines: DataFrame, put=written) -> DataFrame:
    """JON-12: by names; equal names are compared once."""
    parties = lines.select("business_no", F.inline(F.array(*[F.struct(F.lit(side).alias("side"), name_core(F.col(side)).alias("party")) for side in ("supplier", "customer")])))
    of = lambda side: F.bool_or(F.col("side") == side).alias(side)
    parties = parties.filter("party <> ''").groupBy("party").agg(F.min("business_no").alias("lo"), F.max("business_no").alias("hi"), of("supplier"), of("customer"))
    names = docs.select("document_id", F.inline(F.array(*[F.struct(F.lit(c).alias("own"), name_core(F.col(c)).alias("name")) for c in ("seller", "company")]))).filter("name <> ''")
    a, b = names.select("name").distinct(), parties.select("party")
    pairs = containment_join(a, b, "name", "party", put=put).unionByName(containment_join(b, a, "party", "name", put=put).select("name", "party")).distinct()
    per = pairs.join(parties, "party").groupBy("name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_or("supplier").alias("supplier"), F.bool_or("customer").alias("customer"))
    hits = names.join(per, "name")
    found = F.when(F.col("own") == "seller", way("seller", F.col("supplier"), F.col("customer"))).otherwise(way("company", F.col("supplier"), F.col("customer")))
    return reach(hits, "document_id", found)


def cargo_reach(docs: DataFrame, lines: DataFrame, own: list[str] = config.OWN_ENTITIES, put=written) -> DataFrame:
    """JON-13: cargo documents whose text holds a line's vessel; the receiver gives the direction.  Equal texts are compared once, and lines
    of the same vessel and parties are one."""
    cargo = docs.filter("role = 'cargo_right'").withColumn("_text", norm_text(F.col("text"))).filter("_text <> ''")
    ships = lines.withColumn("_ship", norm_text(F.col("vessel"))).filter("_ship <> ''")
    ships = ships.groupBy("_ship", "customer", "supplier").agg(F.min("business_no").alias("lo"), F.max("business_no").alias("hi"))
    # Names are made on either side of the join, once for each row, as the direction asks for them many times.
    hits = containment_join(cargo, ships, "_text", "_ship", put=put).withColumn("_to", name_core(cargo_receiver(F.col("_text"))))
    to = F.col("_to")
    hits = hits.join(ships.select("_ship", "lo", "hi", *[name_core(F.col(c)).alias(c) for c in ("customer", "supplier")]), "_ship")
    ours = reduce(lambda a, b: a | b, [F.contains(to, F.lit(w)) for w in own])
    named = reduce(lambda a, b: a | b, [F.contains(F.col("_text"), F.lit(w)) for w in own])
    direction = F.when(ours, "up").when(like(to, F.col("customer")), "down").when(like(to, F.col("supplier")), "up").when(named, "up")
    hits = hits.withColumn("direction", direction).filter("direction IS NOT NULL")
    return cargo.select("document_id", "_text").join(reach(hits, "_text", F.struct(F.lit(0).alias("rank"), "direction")), "_text").drop("_text")


def bind(lines: DataFrame, docs: DataFrame, up_numbers: list[str], down_numbers: list[str], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JON-10, JON-15: (bound, pool).  Bound: the documents' columns (those in `keep`, if given) with business_no, direction, basis and
    multi (bound to several lines by number).  Documents are read for each way, so they should be a table.  By contract number first; what has none of a line's binds by amount, then party, or by vessel and receiver, if
    exactly one line fits.  Pool: what is left.  Whether one line fits is told by the smallest and the largest that do, so no pairs of
    documents and lines are made for names and amounts that many share.  What each way finds is written, and deleted at the end, so the
    files of its shuffles don't wait for those of the others."""
    with scratch(docs.sparkSession) as put:
        marked, kept = _marked(lines, docs, up_numbers, down_numbers, keep, put)
    guess = F.when(F.col("basis") == "number", F.coalesce("_direction", "direction")).otherwise(F.col("_direction"))
    bound = marked.filter("basis IS NOT NULL").withColumn("direction", guess).drop("_direction")
    return bound, marked.filter("basis IS NULL").select(*kept)


def _marked(lines: DataFrame, docs: DataFrame, up_numbers: list[str], down_numbers: list[str], keep: list[str] | None, put) -> tuple[DataFrame, list[str]]:
    """The documents as a table, each with the lines that it is bound to or a row of nulls, and the names of their own columns."""
    wide = range(max(len(up_numbers), len(down_numbers)))
    side = lambda to, own: lines.select(F.concat_ws("/", F.lit(to), "business_no").alias("_line"), *[(F.col(own[k]) if k < len(own) else F.lit("")).alias(f"_n{k}") for k in wide])
    pairs = variant_join(docs, side("up", up_numbers).unionByName(side("down", down_numbers)), ["contract_no"], [f"_n{k}" for k in wide], "document_id", "_line")
    line = F.split("_line", "/", 2)
    pairs = pairs.select("document_id", line[1].alias("business_no"), line[0].alias("direction")).repartition("document_id")
    numbered = pairs.groupBy("document_id", "business_no").agg(F.max("direction").alias("direction"))  # up goes before down
    numbered = numbered.groupBy("document_id").agg(F.collect_list(F.struct("business_no", "direction")).alias("own"))
    plain = docs.filter("role NOT IN ('other', 'cargo_right')")
    numbered = put(numbered, "numbered")
    parts = {"amount": put(amount_reach(plain.filter("amount IS NOT NULL"), lines), "amount")}
    if {"supplier", "customer"} <= set(lines.columns) and {"seller", "company"} <= set(docs.columns):
        parts["party"] = put(party_reach(plain, lines, put), "party")
        if "vessel" in lines.columns and "text" in docs.columns:
            parts["cargo"] = put(cargo_reach(docs, lines, put=put), "cargo")
    # One row for the lines by number, and the smallest and largest line of each other way; a document's own rows meet once, and its
    # numbers go before the rest.  Rows are dealt out before they are grouped, so they are sorted once for that and the join.
    to = lambda k, n, direction: F.struct(F.lit(k).alias("k"), F.lit(n).alias("basis"), direction.alias("direction")).alias("way")
    no = F.lit(None).cast("string")
    every = [numbered.select("document_id", no.alias("lo"), no.alias("hi"), to(-1, "number", no), "own")]
    every += [p.select("document_id", "lo", "hi", to(k, n, F.col("way.direction")), F.lit(None).cast(every[0].schema["own"].dataType).alias("own")) for k, (n, p) in enumerate(parts.items())]
    found = reduce(DataFrame.unionByName, every).repartition("document_id").groupBy("document_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("way").alias("way"), F.max("own").alias("own"))
    line_of = lambda number, direction, basis, multi: F.struct(number.alias("business_no"), direction.alias("_direction"), basis.alias("basis"), multi.alias("multi"))
    single = F.when(F.col("lo") == F.col("hi"), F.array(line_of(F.col("lo"), F.col("way.direction"), F.col("way.basis"), F.lit(False))))
    known = F.transform("own", lambda x: line_of(x["business_no"], x["direction"], F.lit("number"), F.size("own") > 1))
    found = found.select("document_id", F.when(F.col("own").isNotNull(), known).otherwise(single).alias("_lines")).filter("_lines IS NOT NULL")
    # The rules read it many times; a document that nothing binds has a row of nulls.
    kept = [c for c in docs.columns if keep is None or c in {"document_id", "direction", *keep}]
    marked = written(docs.select(*kept).join(found, "document_id", "left").select("*", F.inline_outer("_lines")).drop("_lines"), "bound")
    return marked, kept


def statements(lines: DataFrame, docs: DataFrame, numbers: list[str]) -> DataFrame:
    """JON-14: (document_id, business_no, basis) of documents of no other role whose text mentions a number of the line, in full or in a
    list; a statement may belong to many lines."""
    own = lines.select("business_no", F.explode(F.array_distinct(F.flatten(F.array(*[contract_variants(F.col(c)) for c in numbers])))).alias("_no")).filter("_no <> ''")
    texts = docs.filter("role = 'other' AND coalesce(text, '') <> ''").select("document_id", "text")
    hits = texts.join(mentions(texts, own, "text", "_no"), "text").join(own, "_no")
    return hits.select("document_id", "business_no", F.lit("statement").alias("basis")).distinct()


def subset_sums(docs: DataFrame, lines: DataFrame, most: int = 8) -> DataFrame:
    """FN-56: documents of a line and role that no side has taken, two to eight with amounts: the largest set whose sum is within
    the tolerance of an anchor, of equals the first by mask.  Returns document_id, business_no, direction.  Masks are bounded (255),
    and their sums, made by doubling, stay within their group's row: documents and anchors are all that is shuffled."""
    open_ = docs.filter("direction = 'unknown' AND role <> 'other' AND amount IS NOT NULL").select("document_id", "business_no", "role", "amount")
    groups = open_.repartition("business_no").groupBy("business_no", "role").agg(F.array_sort(F.collect_list(F.struct("document_id", "amount"))).alias("own")).filter(F.size("own").between(2, most))
    known = lines.select("business_no", anchor_list(lines).alias("_a")).filter(F.size("_a") > 0).groupBy("business_no").agg(F.flatten(F.collect_list("_a")).alias("_a"))
    wide_ = "decimal(28,2)"
    sums = F.aggregate("own", F.array(F.lit(0).cast(wide_)), lambda s, d: F.concat(s, F.transform(s, lambda x: (x + d["amount"]).cast(wide_))))
    near = lambda s: F.transform(F.filter("_a", lambda a: F.abs(s - a["anchor"]) <= money(TOL)), lambda a: F.struct(a["rank"].alias("rank"), a["direction"].alias("direction")))
    fits = F.transform("_sums", lambda s, m: F.struct((-F.bit_count(m)).alias("size"), m.alias("mask"), F.array_min(near(s)).alias("to")))
    best = F.array_min(F.filter(fits, lambda f: (f["mask"] > 0) & f["to"].isNotNull()))
    hits = groups.join(known, "business_no").withColumn("_sums", sums).select("business_no", "own", F.explode(F.filter(F.array(best), lambda b: b.isNotNull())).alias("b"))
    picked = F.filter("own", lambda d, i: F.call_function("shiftright", F.col("b.mask"), i).bitwiseAND(1) == 1)
    return hits.select("business_no", F.explode(picked).alias("d"), F.col("b.to.direction").alias("direction")).select(F.col("d.document_id").alias("document_id"), "business_no", "direction")


def assign(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """Step 1 of the rules, for documents of a line whose side isn't known: by an anchor of their line, then by its parties, then
    two to eight of a role by their sum.  Adds nothing but direction (and basis, if there is one)."""
    with scratch(docs.sparkSession) as put:
        waiting = put(docs.filter("direction = 'unknown' AND role <> 'other'"), "waiting")
        if waiting.isEmpty():  # then no line is read
            return docs
        out = written(_assigned(lines, docs, waiting, put), "assigned")
    settled = docs.filter("NOT coalesce(direction = 'unknown' AND role <> 'other', false)")  # only documents that wait are moved
    return settled.unionByName(out)  # settled ones stay where they are


def _assigned(lines: DataFrame, docs: DataFrame, waiting: DataFrame, put) -> DataFrame:
    single = by_amount(waiting.filter("amount IS NOT NULL"), lines).withColumn("_basis", F.lit("amount"))
    if {"supplier", "customer"} <= set(lines.columns) and {"seller", "company"} <= set(docs.columns):
        # The line is known, so its names are compared with the document's as they are.
        own = waiting.select("document_id", "business_no", "seller", "company").join(lines.select("business_no", "supplier", "customer"), "business_no")
        fits = lambda c: way(c, like(name_core(F.col(c)), name_core(F.col("supplier"))), like(name_core(F.col(c)), name_core(F.col("customer"))))
        party = own.withColumn("_way", F.array_min(F.array(fits("seller"), fits("company")))).filter("_way IS NOT NULL")
        party = party.groupBy("document_id", "business_no").agg(F.min("_way")["direction"].alias("direction"))
        party = party.join(single.select("document_id", "business_no"), ["document_id", "business_no"], "left_anti")
        single = single.unionByName(party.withColumn("_basis", F.lit("party")))
    single = put(single, "single")
    rest = waiting.join(single.select("document_id", "business_no"), ["document_id", "business_no"], "left_anti")
    every = single.unionByName(subset_sums(rest, lines).withColumn("_basis", F.lit("sum"))).withColumnRenamed("direction", "_direction")
    out = waiting.join(every, ["document_id", "business_no"], "left").withColumn("direction", F.coalesce("_direction", "direction"))
    if "basis" in docs.columns:
        out = out.withColumn("basis", F.coalesce("_basis", "basis"))
    return out.select(*docs.columns)


# Cells


CELL = ["business_no", "direction", "role"]


def unique_in_cell(docs: DataFrame) -> DataFrame:
    """WIN-04, JON-27: kept_id, the document of which one is a copy within its cell: the first kept one that is the same picture, if the
    documents have fingerprints, else the first of the same number, amount and day; a document without all three is its own."""
    if "phash" in docs.columns:
        found = image_leaders(docs, "document_id", CELL).filter("id <> kept_id")
        found = found.select(F.col("id").alias("document_id"), F.col("kept_id").alias("_image"), *CELL)
        own = ["document_id", *CELL]
        copies = docs.join(found, own).select(*docs.columns, F.col("_image").alias("kept_id"))
        return copies.unionByName(same_key(docs.join(found, own, "left_anti")))
    return same_key(docs)


def same_key(docs: DataFrame) -> DataFrame:
    """kept_id by number, amount and day."""
    keyed = (F.coalesce("contract_no", F.lit("")) != "") & F.col("amount").isNotNull() & F.col("doc_date").isNotNull()
    w = Window.partitionBy(*CELL, "contract_no", "amount", "doc_date").orderBy("document_id")
    first = docs.filter(keyed).withColumn("kept_id", F.first("document_id").over(w))
    # rows that lack a part can't repeat, so they are their own and aren't shuffled
    return first.unionByName(docs.filter(~keyed).withColumn("kept_id", F.col("document_id")))


def cells(docs: DataFrame) -> DataFrame:
    """Grouped documents of each line, direction and role: count, ids, the sum (null if no amount is known), the sum of goods alone,
    and what isn't payment for goods.  Repeated documents count once in the sums."""
    return grouped(docs.filter("direction IN ('up', 'down')"))


def grouped(docs: DataFrame) -> DataFrame:
    """Cells of any direction.  Without fingerprints, documents are dealt out by their lines once, for copies and cells."""
    if "phash" in docs.columns:
        sided = F.coalesce(F.col("direction").isin("up", "down"), F.lit(False))
        own = unique_in_cell(docs.filter(sided)).unionByName(docs.filter(~sided).withColumn("kept_id", F.col("document_id")))
    else:
        keyed = (F.coalesce("contract_no", F.lit("")) != "") & F.col("amount").isNotNull() & F.col("doc_date").isNotNull()
        w = Window.partitionBy(*CELL, "contract_no", "amount", "doc_date", F.when(~keyed, F.col("document_id"))).orderBy("document_id")
        read = ["document_id", *CELL, "nature", "contract_no", "amount", "doc_date"]
        own = docs.select(*read).repartition("business_no").withColumn("kept_id", F.first("document_id").over(w))
    kept = F.col("kept_id") == F.col("document_id")
    goods = kept & (F.col("nature") == "payment")
    extra = F.col("nature") != "payment"
    return own.groupBy("business_no", "direction", "role").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("direction") != "unknown", F.col("document_id")))).alias("ids"),
        F.sum(F.when(kept, F.col("amount"))).cast(MONEY).alias("amount"),
        F.sum(F.when(goods, F.col("amount"))).cast(MONEY).alias("goods"),
        F.count_if(extra).alias("n_extra"),
        F.array_sort(F.collect_list(F.when(extra, F.col("document_id")))).alias("extra_ids"),
    )


def matrix(lines: DataFrame, docs: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """AGG-12: ten cells for each line: n, amount (goods alone for receipts; 0 if unknown) and candidates (unknown direction)."""
    every = F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(r).alias("role")) for d in ("up", "down") for r in config.ROLES])
    full = lines.select("business_no", F.inline(every)).join(cells(docs), ["business_no", "direction", "role"], "left")
    value = F.when(F.col("role") == "payment_receipt", F.col("goods")).otherwise(F.col("amount"))
    unknown = docs.filter("direction = 'unknown'") if candidates is None else candidates
    waiting = unknown.groupBy("business_no", "role").agg(F.count("*").alias("candidates"))
    return full.join(waiting, ["business_no", "role"], "left").select(
        "business_no", "direction", "role", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(value, money()).alias("amount"), F.coalesce("candidates", F.lit(0)).alias("candidates")
    )


def wide(lines: DataFrame, docs: DataFrame, ids: bool = True) -> DataFrame:
    """Lines with a struct for each checked cell (null if it's empty), the numbers of candidates by role and of all documents (null if
    none): one join, from which R1 to R4 are projections.  Without `ids` cells are numbers alone, and no lists are made."""
    fields = ["n", "amount", "goods", "n_extra", *(["ids", "extra_ids"] if ids else [])]
    of = lambda d, r: (F.col("direction") == d) & (F.col("role") == r)
    own = grouped(docs).groupBy("business_no").agg(
        *[F.max(F.when(of(d, r), F.col(f))).alias(f"_{d}_{r}_{f}") for d, r in config.CHECKED_CELLS for f in fields],
        *[F.sum(F.when(of("unknown", r), F.col("n"))).alias(f"waiting_{r}") for r in config.ROLES],
        F.sum("n").alias("n_bound"),
    )
    cell = lambda d, r: F.when(F.col(f"_{d}_{r}_n").isNotNull(), F.struct(*[F.col(f"_{d}_{r}_{f}").alias(f) for f in fields])).alias(f"cell_{d}_{r}")
    own = own.select("business_no", *[cell(d, r) for d, r in config.CHECKED_CELLS], *[f"waiting_{r}" for r in config.ROLES], "n_bound")
    return lines.join(own, "business_no", "left")


def item(when: Column, rule: str, kind: str, severity: Column | str, direction: str, role: str, expected: Column | None = None, actual: Column | None = None, delta: Column | None = None, ids: Column | None = None, read: list[str] | None = None) -> Column:
    """A difference as a struct, of the columns in `read` if given, or null unless the condition holds."""
    c = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = [F.lit(rule), F.lit(kind), c(severity), F.lit(direction), F.lit(role), *[F.lit("") if x is None else x for x in (expected, actual, delta)], F.array().cast("array<string>") if ids is None else ids]
    return F.when(when, F.struct(*[p.alias(n) for p, n in zip(parts, DIFF[1:], strict=True) if read is None or n in read]))


def listed(rows: DataFrame, items: list[Column]) -> DataFrame:
    return rows.select("business_no", F.inline(F.filter(F.array(*items), lambda x: x.isNotNull())))


# Rules


def completeness_items(item: Callable[..., Column] = item) -> list[Column]:
    known = lambda a, b: F.coalesce(F.abs(F.col(a)) > money(TOL), F.lit(False)) | F.coalesce(F.abs(F.col(b)) > money(TOL), F.lit(False))
    out = []
    for d, r in config.CHECKED_CELLS:
        cell = F.col(f"cell_{d}_{r}")
        active = known("up_settlement", "pay_amount") if d == "up" else known("down_settlement", "receipt_amount")
        severity = F.when((F.col(f"waiting_{r}") > 0) | F.lit(r == "payment_receipt") | ~active, "WARNING").otherwise("CRITICAL")
        out += [
            item(cell["n_extra"] > 0, "R1", "amount_mismatch", "INFO", d, r, F.lit("goods only"), cell["n_extra"].cast("string"), ids=cell["extra_ids"]),
            item(cell.isNotNull() & cell["amount"].isNull(), "R1", "unparsed_amount", "WARNING", d, r, ids=cell["ids"]),
            item(cell.isNull(), "R1", "missing_doc", severity, d, r, F.lit(">=1"), F.lit("0")),
        ]
    return out


def amount_item(rule: str, direction: str, role: str, expected: str, under: str, item: Callable[..., Column] = item) -> Column:
    """FN-58: CRITICAL, or `under` where the documents' amount is the smaller."""
    e, cell = F.col(expected), F.col(f"cell_{direction}_{role}")
    a = cell["amount"]
    severity = F.when(a < e, under).otherwise("CRITICAL")
    return item(off(a, e), rule, "amount_mismatch", severity, direction, role, amount_text(e), amount_text(a), amount_text(a - e), cell["ids"])


def upstream_items(item: Callable[..., Column] = item) -> list[Column]:
    s, p, cell = F.col("up_settlement"), F.col("pay_amount"), F.col("cell_up_payment_receipt")
    covered = F.coalesce(cell["goods"], money())
    severity = F.when(cell["goods"].isNull(), "INFO").when(covered > p, "CRITICAL").otherwise("WARNING")
    return [
        amount_item("R2", "up", "settlement", "up_settlement", "CRITICAL", item),
        amount_item("R2", "up", "invoice", "up_settlement", "WARNING", item),
        item(off(p, s), "R2", "amount_mismatch", "INFO", "up", "payment_receipt", amount_text(s), amount_text(p), amount_text(p - s)),
        item(off(covered, p), "R2", "amount_mismatch", severity, "up", "payment_receipt", amount_text(p), amount_text(covered), amount_text(covered - p), F.coalesce(cell["ids"], F.array().cast("array<string>"))),
    ]


def downstream_items(item: Callable[..., Column] = item) -> list[Column]:
    return [amount_item("R3", "down", "settlement", "down_settlement", "CRITICAL", item), amount_item("R3", "down", "invoice", "down_settlement", "WARNING", item)]


def interest_items(item: Callable[..., Column] = item) -> list[Column]:
    up, down, r, s = F.col("up_settlement"), F.col("down_settlement"), F.col("interest_receivable"), F.col("interest_received")
    gap = down - up
    fits = F.coalesce(F.abs(gap - r) <= money(TOL), F.lit(False)) | F.coalesce(F.abs(gap - s) <= money(TOL), F.lit(False))
    ref = F.coalesce(r, s)
    known = gap.isNotNull()
    return [
        item(known & fits & off(r, s), "R4", "interest_mismatch", "INFO", "cross", "interest", amount_text(r), amount_text(s), amount_text(s - r)),
        item(known & ~fits & ref.isNotNull(), "R4", "interest_mismatch", "CRITICAL", "cross", "interest", amount_text(gap), amount_text(ref), amount_text(ref - gap)),
        item(known & ref.isNull() & (F.abs(gap) > money(TOL)), "R4", "interest_mismatch", "WARNING", "cross", "interest", amount_text(up), amount_text(down), amount_text(gap)),
    ]


def r1_completeness(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """R1: cells with deposits or refunds (INFO), cells without a known amount (WARNING), and missing documents: WARNING if there are
    candidates, the ledger has no amount or it's a receipt, else CRITICAL (FN-57)."""
    return listed(wide(lines, docs), completeness_items())


def r2_upstream(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """R2: settlement documents and invoices against the ledger's settlement, the ledger's payment against it (INFO), and receipts
    against the payment: none is INFO, more is CRITICAL, less is WARNING."""
    return listed(wide(lines, docs), upstream_items())


def r3_downstream(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """R3: settlement documents and invoices against the ledger's sale settlement."""
    return listed(wide(lines, docs), downstream_items())


def r4_interest(lines: DataFrame) -> DataFrame:
    """R4: the settlements' gap is the interest receivable or received: if either fits, INFO if they differ; if neither, CRITICAL; if
    none is registered, WARNING for a gap."""
    return listed(lines, interest_items())


def r5_membership(lines: DataFrame, docs: DataFrame, numbers: list[str]) -> DataFrame:
    """R5: documents with a number that isn't one of their line's: INFO if their amount is one of its anchors, else WARNING."""
    every = F.array_distinct(F.flatten(F.array(*[contract_variants(F.col(c)) for c in numbers])))
    # A line's numbers and anchors are one row, so a document meets both at once.
    known = lines.select("business_no", every.alias("_own"), anchor_list(lines).alias("_a")).groupBy("business_no").agg(F.collect_list("_own").alias("_owns"), F.flatten(F.collect_list("_a")).alias("_a"))
    own = docs.filter("direction <> 'unknown' AND coalesce(contract_no, '') <> ''").select("business_no", "document_id", "direction", "role", "contract_no", "amount").join(known, "business_no")
    own = own.withColumn("_variants", contract_variants(F.col("contract_no")))
    # explode() would have the filter evaluated once more, to tell whether anything is left
    rows = own.withColumn("_alien", F.explode_outer(F.filter("_owns", lambda o: ~F.arrays_overlap("_variants", o)))).filter("_alien IS NOT NULL")
    near = F.exists("_a", lambda a: F.abs(F.col("amount") - a["anchor"]) <= money(TOL))
    return diff(rows, "R5", "chain_break", F.when(near, "INFO").otherwise("WARNING"), F.col("direction"), F.col("role"), actual=F.col("contract_no"), ids=F.array("document_id"))


def r6_dates(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """R6: documents dated before their side's contract."""
    rows = docs.join(lines.select("business_no", "up_contract_date", "down_contract_date"), "business_no")
    since = F.when(F.col("direction") == "up", F.col("up_contract_date")).when(F.col("direction") == "down", F.col("down_contract_date"))
    early = rows.filter(F.col("doc_date") < since)
    return diff(early, "R6", "date_conflict", "WARNING", F.col("direction"), F.col("role"), since.cast("string"), F.col("doc_date").cast("string"), ids=F.array("document_id"))


def r7_invoices(docs: DataFrame) -> DataFrame:
    """R7, WIN-05: invoice numbers that come again within a line, with the first document that bears them."""
    rows = docs.filter("role = 'invoice' AND coalesce(invoice_no, '') <> ''")
    w = Window.partitionBy("business_no", "invoice_no").orderBy("document_id")
    rows = rows.withColumn("_first", F.first("document_id").over(w)).filter(F.col("_first") != F.col("document_id"))
    return diff(rows, "R7", "duplicate_biz", "WARNING", F.col("direction"), "invoice", actual=F.col("invoice_no"), ids=F.array("_first", "document_id"))


def repeated(docs: DataFrame) -> DataFrame:
    """Repeated documents of a cell, INFO, with the one that counts."""
    rows = unique_in_cell(docs.filter("direction IN ('up', 'down')")).filter("kept_id <> document_id")
    return diff(rows, "DUP", "amount_mismatch", "INFO", F.col("direction"), F.col("role"), ids=F.array("kept_id", "document_id"))


def several_lines(docs: DataFrame) -> DataFrame:
    """R7: documents that are bound to several lines."""
    return diff(docs.filter("multi"), "R7", "duplicate_biz", "WARNING", F.col("direction"), F.col("role"), ids=F.array("document_id"))


def ledger_gaps(lines: DataFrame) -> DataFrame:
    """Lines that the settlement or the payment sheet doesn't have."""
    parts = [diff(lines.filter(c), "LEDGER", "ledger_missing", "WARNING", role=name) for c, name in (("settlement_missing", "settlement"), ("payment_missing", "payment")) if c in lines.columns]
    return reduce(DataFrame.unionByName, parts) if parts else diff(lines.limit(0), "LEDGER", "ledger_missing", "WARNING")


def unclassified(docs: DataFrame) -> DataFrame:
    """Documents of a known role whose side isn't known, INFO, one row for each line."""
    rows = docs.filter("direction = 'unknown' AND role <> 'other'").groupBy("business_no").agg(F.array_sort(F.collect_list("document_id")).alias("ids"))
    return diff(rows, "SIDE", "unclassified_doc", "INFO", ids=F.col("ids"))


#: What the rules read of the documents.
RULES_READ = ["document_id", "business_no", "direction", "role", "nature", "amount", "doc_date", "invoice_no", "contract_no", "multi", "phash", "img_w", "img_h"]


def differences(lines: DataFrame, docs: DataFrame, numbers: list[str], put=None, read: list[str] | None = None) -> DataFrame:
    """All rules; lines without documents have no differences (status no_data).  Each rule reads the documents, so they should be a table
    or cheap to derive from one.  With `put`, which writes a table, a rule's shuffles end before the next one's begin.  With `read` there are
    business_no and these columns alone, and what only others need isn't made."""
    docs = docs.select(*[c for c in RULES_READ if c in docs.columns]).filter("business_no IS NOT NULL")
    made = DIFF if read is None or "key" in read else read
    one = partial(item, read=made)
    cells_of = wide(lines, docs, "document_ids" in made).filter("n_bound > 0")
    parts = [
        repeated(docs), listed(cells_of, [*completeness_items(one), *upstream_items(one), *downstream_items(one), *interest_items(one)]),
        r5_membership(lines, docs, numbers), r6_dates(lines, docs), r7_invoices(docs), unclassified(docs),
    ]
    if {"settlement_missing", "payment_missing"} & set(lines.columns):
        parts.append(ledger_gaps(lines).join(docs.select("business_no").distinct(), "business_no", "left_semi"))
    if "multi" in docs.columns:
        parts.append(several_lines(docs))
    key = diff_key(F.col("type"), F.col("direction"), F.col("role"), F.col("expected"), F.col("actual"), F.col("document_ids"))
    if read is not None:
        parts = [(p.withColumn("key", key) if "key" in read else p).select("business_no", *read) for p in parts]
    out = reduce(DataFrame.unionByName, [put(p) for p in parts] if put else parts)
    return out.withColumn("key", key) if read is None else out  # made when it is read, as it takes more room than the rest


# Status and closure


def rank_of(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in config.SEVERITY.items():
        out = F.when(severity == name, F.lit(rank)).otherwise(out)
    return out


def statuses(lines: DataFrame, docs: DataFrame, diffs: DataFrame) -> DataFrame:
    """AGG-13: error, warning or ok by the worst difference that isn't closed; no_data without documents."""
    open_ = diffs.filter(~F.coalesce("closed", F.lit(False))) if "closed" in diffs.columns else diffs
    worst = open_.groupBy("business_no").agg(F.max(rank_of(F.col("severity"))).alias("worst"), F.count("*").alias("n_diffs"))
    bound = docs.groupBy("business_no").agg(F.count("*").alias("n_docs"))
    status = F.when(F.col("n_docs").isNull(), "no_data").when(F.col("worst") == 2, "error").when(F.col("worst") == 1, "warning").otherwise("ok")
    return lines.select("business_no").join(bound, "business_no", "left").join(worst, "business_no", "left").select(
        "business_no", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_diffs", F.lit(0)).alias("n_diffs"), status.alias("status")
    )


def closure(old: DataFrame, new: DataFrame) -> DataFrame:
    """JON-28, WIN-12, SET-06: differences of two runs by line and key: state new, carried (with the old resolution) or resolved,
    and closed for resolutions that take a difference out of the count."""
    a = old.select("business_no", "key", F.col("severity").alias("_old"), "resolution")
    b = new.select("business_no", "key", F.col("severity").alias("_new"))
    both = a.join(b, ["business_no", "key"], "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "resolved").otherwise("carried")
    return both.select("business_no", "key", F.coalesce("_new", "_old").alias("severity"), state.alias("state"), "resolution", F.coalesce(F.col("resolution").isin(config.CLOSING), F.lit(False)).alias("closed"))


def resolve(diffs: DataFrame, business_no: str, key: str, resolution: str) -> DataFrame:
    """DML-02: sets one difference's resolution; reopen clears it."""
    if resolution not in config.RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution}")
    hit = (F.col("business_no") == business_no) & (F.col("key") == key)
    value = F.lit(None).cast("string") if resolution == "reopen" else F.lit(resolution)
    return diffs.withColumn("resolution", F.when(hit, value).otherwise(F.col("resolution")))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """JON-29: lines whose status or number of differences isn't what it was, or that are new."""
    a = before.select("business_no", F.col("status").alias("old_status"), F.col("n_diffs").alias("old_n"))
    rows = after.join(a, "business_no", "left")
    return rows.filter(~(F.col("status").eqNullSafe(F.col("old_status")) & F.col("n_diffs").eqNullSafe(F.col("old_n")))).select("business_no", "old_status", "status", "old_n", "n_diffs")


def upsert_reports(old: DataFrame, new: DataFrame, key: str = "business_no") -> DataFrame:
    """SNK-02: new reports replace old ones; urges, if there are any, survive a new run (quirk Q4: as documented)."""
    if "urges" in old.columns and "urges" not in new.columns:
        new = new.join(old.select(key, "urges"), key, "left")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def urge_list(diffs: DataFrame) -> DataFrame:
    """AGG-19, SRT-08: lines with missing documents: how many, and of which sides and roles."""
    missing = diffs.filter("type = 'missing_doc'")
    return missing.groupBy("business_no").agg(F.count("*").alias("n_missing"), F.array_sort(F.collect_set(F.concat_ws("/", "direction", "role"))).alias("missing"))


def invoice_uniqueness(docs: DataFrame, least: int = 6) -> DataFrame:
    """JON-30, AGG-20: invoice numbers of six characters or more that stand in several lines."""
    rows = docs.filter((F.col("role") == "invoice") & (F.char_length("invoice_no") >= least))
    lines = rows.groupBy("invoice_no").agg(F.array_sort(F.collect_set("business_no")).alias("lines"))
    return lines.filter(F.size("lines") > 1)


def summary(lines: DataFrame, status: DataFrame, by: list[str]) -> DataFrame:
    """AGG-15: sums and numbers of lines by customer or by month; with several columns, grouping sets of each of them."""
    sums = ["up_settlement", "down_settlement", "pay_amount", "receipt_amount", "interest_receivable", "interest_received"]
    rows = lines.join(status.select("business_no", "status"), "business_no")
    aggs = [*[F.coalesce(F.sum(c), money()).cast(MONEY).alias(c) for c in sums], F.count("*").alias("n_lines"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("error", "warning", "ok", "no_data")]]
    if len(by) == 1:
        return rows.groupBy(by[0]).agg(*aggs)
    return rows.groupingSets([[F.col(c)] for c in by], *[F.col(c) for c in by]).agg(*aggs)
