"""Entity-attribute-value rows: latest wins, pivots, upserts, search predicates (JON-01, JON-06, WIN-01 to WIN-03, FLT-04 to FLT-07)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(fields: DataFrame, entity: str = "document_id", order: str = "id") -> DataFrame:
    """WIN-01: the newest row of each entity and field."""
    w = Window.partitionBy(entity, "field_name").orderBy(F.desc(order))
    return fields.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def pivot(fields: DataFrame, aliases: dict[str, list[str]], entity: str = "document_id", order: str = "id") -> DataFrame:
    """JON-06, WIN-02: a column for each field: the newest value, under any of its names, that isn't empty."""
    known = {a: name for name, names in aliases.items() for a in names}
    rows = fields.filter(F.col("field_name").isin(*known) & (F.coalesce("field_value", F.lit("")) != ""))
    value = lambda names: F.max_by(F.when(F.col("field_name").isin(*names), F.col("field_value")), F.when(F.col("field_name").isin(*names), F.col(order)))
    return rows.groupBy(entity).agg(*[value(names).alias(name) for name, names in aliases.items()])


def nested(docs: DataFrame, fields: DataFrame, key: str = "id", entity: str = "document_id") -> DataFrame:
    """JON-01, PRJ-02: documents with a map of their fields; of several values of a name the newest."""
    own = latest(fields, entity).groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "field_value"))).alias("fields"))
    return docs.join(own, docs[key] == own[entity], "left").drop(entity)


def upsert_fields(old: DataFrame, new: DataFrame, entity: str = "document_id") -> DataFrame:
    """SNK-08: new values (source USER, confidence 1) replace old ones of the same entity and name."""
    keys = [entity, "field_name"]
    fresh = new.select(*keys, "field_value", F.lit(1.0).alias("confidence"), F.lit("USER").alias("source"))
    return old.select(*fresh.columns).join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def field_rows(results: DataFrame, key: str, category: str) -> DataFrame:
    """SNK-13: recognised fields and the suggested category as rows; results: key, field, value, confidence, source, category."""
    own = results.select(F.col(key).alias("document_id"), F.col("field").alias("field_name"), F.col("value").alias("field_value"), "confidence", "source")
    suggested = results.filter(F.coalesce(F.col(category), F.lit("")) != "").select(
        F.col(key).alias("document_id"), F.lit("suggested_category").alias("field_name"), F.col(category).alias("field_value"), F.lit(1.0).alias("confidence"), F.lit("RULE").alias("source")
    )
    return own.unionByName(suggested.distinct())


def matching(fields: DataFrame, names: list[str], like: str | None = None, least=None, most=None, start: str | None = None, end: str | None = None, entity: str = "document_id") -> DataFrame:
    """FLT-05: the entities that have such a value: a substring (case counts), a range of numbers (values that aren't
    numbers don't match), or a range of strings."""
    value, tests = F.coalesce("field_value", F.lit("")), [F.col("field_name").isin(*names)]
    number = F.translate(value, ",", "").try_cast("decimal(24,6)")
    if like:
        tests.append(F.contains(value, F.lit(like)))
    if least is not None:
        tests.append(number >= F.lit(str(least)).cast("decimal(24,6)"))
    if most is not None:
        tests.append(number <= F.lit(str(most)).cast("decimal(24,6)"))
    if start:
        tests.append(value >= start)
    if end:
        tests.append(value <= end)
    return fields.filter(reduce(lambda a, b: a & b, tests)).select(entity).distinct()


def library(docs: DataFrame, status: str | None = None, document_type: str | None = None, limit: int = 200, offset: int = 0, more: Column | None = None) -> DataFrame:
    """FLT-01, FLT-02, SRT-01: the newest documents that aren't recycled.  The type 未识别 means the empty type, not null."""
    rows = docs.filter("status <> 'recycled'")
    if status:
        rows = rows.filter(F.col("status") == status)
    if document_type:
        rows = rows.filter(F.col("document_type") == "" if document_type == "未识别" else F.col("document_type").ilike(f"%{document_type}%"))
    if more is not None:
        rows = rows.filter(more)
    return rows.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).offset(offset).limit(limit)


def keyword_search(docs: DataFrame, fields: DataFrame, keyword: str, types: list[str] = (), entity: str = "document_id") -> DataFrame:
    """FLT-04, SET-07: documents whose name, type or any field holds the keyword (case aside), or whose type is one of
    `types` (fuzzy or phonetic hits of a provider).  % and _ keep their meaning, as in the original."""
    like = f"%{keyword}%"
    hits = fields.filter(F.col("field_value").ilike(like)).select(F.col(entity).alias("_hit")).distinct()
    found = docs.join(hits, docs["id"] == F.col("_hit"), "left")
    return found.filter(F.col("original_filename").ilike(like) | F.col("document_type").ilike(like) | F.col("_hit").isNotNull() | F.col("document_type").isin(*types)).drop("_hit")


def date_search(docs: DataFrame, fields: DataFrame, names: list[str], start: str, end: str) -> DataFrame:
    """FLT-07 with quirk Q3 as it behaves: a field within the range, or created from start on, or created up to end."""
    hits = matching(fields, names, start=start, end=end).withColumnRenamed("document_id", "_hit")
    day = F.date_format("created_at", "yyyy-MM-dd")
    return docs.join(hits, docs["id"] == F.col("_hit"), "left").filter(F.col("_hit").isNotNull() | (day >= start) | (day <= end)).drop("_hit")


def suggestions(docs: DataFrame, fields: DataFrame, keyword: str, values: int = 30, names: int = 10, most: int = 20) -> DataFrame:
    """SRT-03: up to `most` of the types (sorted), field values (sorted) and newest file names that hold the keyword."""
    like = f"%{keyword}%"
    rank = lambda rows, label, k, order: rows.withColumn("_n", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(*order))).select(F.lit(label).alias("label"), "text", F.lit(k).alias("_source"), "_n")
    types = docs.filter(F.col("document_type").ilike(like)).select(F.col("document_type").alias("text")).distinct().orderBy("text").limit(most)
    own = fields.filter(F.col("field_value").ilike(like)).select(F.col("field_value").alias("text")).distinct().orderBy("text").limit(values)
    files = docs.filter(F.col("original_filename").ilike(like)).orderBy(F.desc("id")).limit(names).select(F.col("original_filename").alias("text"), "id")
    every = rank(types, "type", 0, ["text"]).unionByName(rank(own, "field", 1, ["text"])).unionByName(rank(files, "file", 2, [F.desc("id")]))
    return every.orderBy("_source", "_n").limit(most).select("label", "text")


def tree(categories: DataFrame) -> DataFrame:
    """JON-32: id, path and depth of each category, by a recursive query; deeper trees than the session's limit of recursion
    (spark.sql.cteRecursionLevelLimit, 100 by default) are an error."""
    return categories.sparkSession.sql(
        "WITH RECURSIVE t(id, path, depth) AS (SELECT id, name, 0 FROM {c} WHERE parent_id IS NULL UNION ALL "
        "SELECT c.id, concat(t.path, '/', c.name), t.depth + 1 FROM {c} c JOIN t ON c.parent_id = t.id) SELECT * FROM t",
        c=categories,
    )


def duplicates(docs: DataFrame, settled: list[str] = ("archived", "need_review", "duplicate"), key: str = "file_hash") -> DataFrame:
    """JON-17, PRJ-01: documents with duplicate_of, the smallest id of a settled document of the same hash, if it isn't
    their own.  The settled originals are one row for each hash, so no hot hash is joined with itself."""
    first = docs.filter(F.col("status").isin(*settled)).groupBy(key).agg(F.min("id").alias("_first"))
    return docs.join(first, key, "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("id"), F.col("_first"))).drop("_first")


def new_files(found: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-16, SET-03, STR-06: files whose path and hash aren't settled yet; null keys are never settled."""
    return found.join(settled.select(*keys).distinct(), keys, "left_anti")
