"""Lists and changes of the library: filters, worklists, templates, names, overrides (FLT-03, FLT-16, JON-19, JON-35, WIN-13, SET-08, SET-09,
SRT-04, SRT-10, SRT-12, DML-08, SNK-11, PRJ-04, PRJ-06, AGG-28, AGG-36, AGG-37)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.template import rendered


def in_category(docs: DataFrame, fields: DataFrame, names: list[str], value: str, key: str = "id", entity: str = "document_id") -> DataFrame:
    """FLT-03: documents that have the category as the value of one of the fields."""
    hits = fields.filter(F.col("field_name").isin(*names) & (F.col("field_value") == value)).select(F.col(entity).alias(key)).distinct()
    return docs.join(hits, key, "left_semi")


def listed(rows: DataFrame, order: list[Column], enabled: bool = True) -> DataFrame:
    """FLT-16: the rows of a configuration, those that are enabled alone if asked, in their order."""
    return (rows.filter("enabled") if enabled else rows).orderBy(*order)


def with_template(docs: DataFrame, templates: DataFrame, category: str, default: str) -> DataFrame:
    """JON-35: documents with the template of their category, or the default; templates: category, template."""
    own = templates.select(F.col("category").alias("_category"), "template")
    rows = docs.join(own, F.col(category) == F.col("_category"), "left").drop("_category")
    return rows.withColumn("template", F.coalesce("template", F.lit(default)))


def suggested_names(docs: DataFrame, templates: dict[str, str], category: Column, default: str, fields: dict[str, Column], extension: Column) -> DataFrame:
    """PRJ-06: documents with the file name that the template of their category gives.  Templates are few and compiled."""
    name = rendered(default, fields, extension)
    for own, template in templates.items():
        name = F.when(category == own, rendered(template, fields, extension)).otherwise(name)
    return docs.withColumn("suggested_name", name)


#: Categories that a list may have.
MOST_CATEGORIES = 5000


def candidate_types(best: DataFrame, categories: DataFrame, key: str) -> DataFrame:
    """PRJ-04: for each document the enabled categories in their order, the rules' best first if it isn't among them; best: key,
    category; categories: name, sort_order, enabled."""
    few = categories.filter("enabled").orderBy("sort_order", "name").select("name").limit(MOST_CATEGORIES + 1).collect()
    if len(few) > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    names = F.array(*[F.lit(r[0]) for r in few]).cast("array<string>")
    missing = F.col("category").isNotNull() & ~F.array_contains(names, F.col("category"))
    return best.select(key, F.when(missing, F.array_prepend(names, F.col("category"))).otherwise(names).alias("types"))


def mean_confidence(fields: DataFrame, entity: str = "document_id") -> DataFrame:
    """AGG-28: the mean confidence of each document's fields; documents without fields have no row (0 to their readers)."""
    return fields.groupBy(entity).agg(F.avg("confidence").alias("confidence"))


def worst_level(checks: DataFrame, by: list[str], levels: list[str] = ("ok", "warning", "error")) -> DataFrame:
    """AGG-36: the worst level of each group of checks."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    return checks.groupBy(*by).agg(F.element_at(F.array(*map(F.lit, levels)), F.max(rank).cast("int")).alias("level"))


def open_records(docs: DataFrame, path: str, statuses: list[str]) -> DataFrame:
    """WIN-13: the newest record of each path that is still open."""
    rows = docs.filter(F.col("status").isin(*statuses))
    return rows.groupBy(path).agg(F.max("id").alias("id"))


def worklist(parts: list[DataFrame], key: str = "id") -> DataFrame:
    """SET-08: the rows of several lists, each id once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def candidates(docs: DataFrame, links: DataFrame, business_no: str) -> DataFrame:
    """SET-09: documents that a dossier doesn't hold yet; links: business_no, document_id."""
    own = links.filter(F.col("business_no") == business_no).select(F.col("document_id").alias("id")).distinct()
    return docs.join(own, "id", "left_anti")


def retried(jobs: DataFrame, cancelled: DataFrame) -> DataFrame:
    """DML-08: failed jobs wait again with one more attempt; jobs that were cancelled and aren't done are cancelled."""
    rows = jobs.join(cancelled.select("id").distinct().withColumn("_cancel", F.lit(True)), "id", "left")
    stop = F.col("_cancel") & ~F.col("status").isin("done", "cancelled")
    status = F.when(stop, "cancelled").when(F.col("status") == "failed", "pending").otherwise(F.col("status"))
    attempts = F.when((F.col("status") == "failed") & F.col("_cancel").isNull(), F.col("attempts") + 1).otherwise(F.col("attempts"))
    return rows.withColumns({"status": status, "attempts": attempts}).drop("_cancel")


def bin_page(recycled: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """SRT-10: the newest deletions first."""
    return recycled.orderBy(F.desc("deleted_at"), F.desc("id")).offset(offset).limit(limit)


def bin_size(recycled: DataFrame) -> DataFrame:
    """AGG-37."""
    return recycled.agg(F.count("*").alias("n"), F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("bytes"))


def by_size(groups: DataFrame, key: str, order: str) -> DataFrame:
    """SRT-04: groups with their size and first member, large ones first, then those that were seen first."""
    return groups.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def previews(rows: DataFrame, by: str, value: str, order: str, most: int = 6) -> DataFrame:
    """SRT-12: the first few values of each group."""
    w = Window.partitionBy(by).orderBy(order)
    few = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most)
    return few.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", value))), lambda x: x[value]).alias("preview"))


def patched(docs: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """SNK-11: documents with the values of a change (one for each id) that aren't null; other columns stay."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    rows = docs.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in own})
    return rows.drop(*[f"_new_{c}" for c in own])


def overridden(docs: DataFrame, found: DataFrame, key: str, contract: Column, own_only: list[str] = ("amount", "quantity")) -> DataFrame:
    """JON-19: field values of documents under those that the ledger knows (confidence 1, source EXCEL).  What a document says of its
    own amount and quantity stays unless it's a contract.  docs: key, values (a map); found: key, values and sale_values (maps)
    and is_sale, by which a sale's side goes before the purchase's."""
    none = F.create_map().cast("map<string,string>")
    filled = lambda m: F.map_filter(F.coalesce(m, none), lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    rows = docs.join(found.select(key, F.col("values").alias("_values"), F.col("sale_values").alias("_sale"), "is_sale"), key, "left")
    sale = F.when(F.coalesce("is_sale", F.lit(False)), filled(F.col("_sale"))).otherwise(none)
    ledger = F.map_concat(F.map_filter(filled(F.col("_values")), lambda k, _: ~F.map_contains_key(sale, k)), sale)
    mine = filled(F.col("values"))
    rows = rows.withColumns({"_mine": mine, "_ledger": ledger, "_contract": contract})
    taken = F.map_filter("_ledger", lambda k, _: F.col("_contract") | ~k.isin(*own_only) | ~F.map_contains_key(F.col("_mine"), k))
    rows = rows.withColumn("_taken", taken)
    merged = F.map_concat(F.map_filter("_mine", lambda k, _: ~F.map_contains_key(F.col("_taken"), k)), F.col("_taken"))
    out = rows.select(*[c for c in docs.columns if c != "values"], merged.alias("values"), F.array_sort(F.map_keys("_taken")).alias("from_ledger"))
    return out


def relocated(missing: DataFrame, files: DataFrame) -> DataFrame:
    """JON-33: for each missing document the file that bears its current, else its original name and, where both hashes are known, its
    hash; by path if several do."""
    names = missing.select("id", F.col("file_hash").alias("_hash"), F.inline(F.array(F.struct(F.lit(0).alias("rank"), F.col("current_filename").alias("name")), F.struct(F.lit(1).alias("rank"), F.col("original_filename").alias("name")))))
    hits = names.join(files.select("name", "path", "file_hash"), "name").filter(F.coalesce(F.col("_hash") == F.col("file_hash"), F.lit(True)))
    return missing.select("id").join(hits.groupBy("id").agg(F.min_by("path", F.struct("rank", "path")).alias("found_path")), "id", "left")
