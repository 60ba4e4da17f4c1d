"""Keyword rules, file-name rules, simulation, confidence and samples (JON-23, JON-24, FLT-12, FLT-13, AGG-22, AGG-23, WIN-06).

Rules are few and are read on the driver, at most MOST of them; each becomes one literal predicate of a single
projection, so that no document is joined with a rule and each pattern is compiled once.
"""

from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.classify import rule_confidence
from ..functions.hashing import count_in
from ..functions.text import norm_type

MOST = 5000
#: Sample documents whose grams a task counts; each has some hundreds.
SAMPLES = 2000


def driver_rows(rules: DataFrame | list[dict]) -> list[dict]:
    """Rules as dicts; more than MOST are an error."""
    if isinstance(rules, list):
        return rules
    rows = [r.asDict() for r in rules.limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules")
    return rows


def valid_pattern(pattern: str) -> bool:
    """Whether the engine's own regular expressions take a pattern."""
    jvm = SparkContext._active_spark_context._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def matches(text: Column, kind: str, keyword: str) -> Column:
    """FLT-12: contains, exact (the whole text or a line of it) or regex; a pattern that is invalid matches nothing."""
    own = F.coalesce(text, F.lit(""))
    if kind == "contains":
        return (own != "") & F.contains(own, F.lit(keyword))
    if kind == "exact":
        return (own != "") & ((F.trim(own) == keyword) | F.array_contains(F.split(own, r"\r\n|\r|\n"), keyword))
    return (own != "") & own.rlike(keyword) if kind == "regex" and valid_pattern(keyword) else F.lit(False)


def rule_scores(docs: DataFrame, rules: DataFrame | list[dict], key: str, text: str) -> DataFrame:
    """JON-23, AGG-22: for each document and category with a hit: score, matched_keywords (by priority, then weight, both
    descending), n_keywords and priority_hits.  Each rule is one boolean of a first projection; the rest are sums over these."""
    rows = [r for r in driver_rows(rules) if r.get("enabled", True)]
    rows.sort(key=lambda r: (-r["priority"], -r["weight"]))
    hits = docs.select(F.col(key), *[matches(F.col(text), r["match_type"], r["keyword"]).alias(f"_hit{k}") for k, r in enumerate(rows)])
    by_category: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        by_category.setdefault(r["category"], []).append(k)
    nothing = F.struct(F.lit(None).cast("string").alias("category"), F.lit(None).cast("decimal(22,3)").alias("score"), F.lit(None).cast("array<string>").alias("matched_keywords"), F.lit(None).cast("int").alias("priority_hits"))
    scored = []
    for category, own in by_category.items():
        when = lambda k, v, none: F.when(F.col(f"_hit{k}"), v).otherwise(none)
        weights = [when(k, F.lit(float(rows[k]["weight"])).cast("decimal(12,3)"), F.lit(0).cast("decimal(12,3)")) for k in own]
        high = [F.col(f"_hit{k}").cast("int") for k in own if rows[k]["priority"] >= config.HIGH_PRIORITY]
        found = F.struct(
            F.lit(category).alias("category"),
            reduce(lambda a, b: (a + b).cast("decimal(22,3)"), weights).cast("decimal(22,3)").alias("score"),
            F.array_compact(F.array(*[when(k, F.lit(rows[k]["keyword"]), None) for k in own])).alias("matched_keywords"),
            reduce(lambda a, b: a + b, high, F.lit(0)).alias("priority_hits"),
        )
        scored.append(F.when(reduce(lambda a, b: a | b, [F.col(f"_hit{k}") for k in own]), found))
    long = hits.select(F.col(key), F.inline(F.array_compact(F.array(*(scored or [F.when(F.lit(False), nothing)])))))
    return long.withColumn("n_keywords", F.size("matched_keywords"))


def best_rule(scores: DataFrame, key: str) -> DataFrame:
    """WIN-06: the best category of each document by score, priority hits and, for ties, name; with its confidence."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), F.desc("priority_hits"), "category")
    best = scores.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return best.withColumn("confidence", rule_confidence(F.col("n_keywords"), F.col("score"), F.col("priority_hits")))


def filename_rule(docs: DataFrame, rules: DataFrame | list[dict], key: str, name: str) -> DataFrame:
    """FLT-13: the first file-name rule that matches (case aside) by priority descending, then id; null if none does."""
    rows = sorted((r for r in driver_rows(rules) if r.get("enabled", True) and valid_pattern(r["pattern"])), key=lambda r: (-r["priority"], r["id"]))
    nothing = F.lit(None).cast("struct<id: bigint, category: string>")
    found = F.coalesce(nothing, *[F.when(F.col(name).rlike("(?i)" + r["pattern"]), F.struct(F.lit(r["id"]).cast("long").alias("id"), F.lit(r["category"]).alias("category"))) for r in rows])
    return docs.select(key, found["id"].alias("rule_id"), found["category"].alias("category"))


def simulate(predicted: DataFrame, key: str, truth: str, guess: str, newest: int) -> DataFrame:
    """AGG-23, SRT-06: the newest documents, of these those with a type; matched, unmatched, misclassified, accuracy, coverage."""
    rows = predicted.orderBy(F.desc(key)).limit(max(1, min(1000, newest))).filter(F.coalesce(F.col(truth), F.lit("")) != "")
    hit, same = F.col(guess).isNotNull(), norm_type(F.col(guess)) == norm_type(F.col(truth))
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(hit & same).alias("matched"),
        F.count_if(~hit).alias("unmatched"),
        F.count_if(hit & ~same).alias("misclassified"),
        F.round(F.try_divide(F.count_if(hit & same).cast("decimal(18,6)"), F.count_if(hit)), 4).cast("double").alias("accuracy"),
        F.round(F.try_divide(F.count_if(hit).cast("decimal(18,6)"), F.count("*")), 4).cast("double").alias("coverage"),
    )


def bigrams(docs: DataFrame, keys: list[str], text: str, letters: str = r"[\x{4e00}-\x{9fff}]", stop: str = config.STOP_CHARS, least: int = 2, most: int = 200) -> DataFrame:
    """AGG-30: neighbouring letters of the given kind, without stop characters, by number; the `most` frequent of each
    group that come `least` times or more."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{letters[1:-1]}]+", "")
    pair = f"(?=([{letters[1:-1]}&&[^{stop}]]{{2}}))." if stop else f"(?=({letters}{{2}}))."  # each place, as the next one starts within this pair
    grams = docs.select(*keys, F.explode(F.regexp_extract_all(bare, F.lit(pair), F.lit(1))).alias("gram"))
    counts = grams.groupBy(*keys, "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "gram")
    return counts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank")


def sample_scores(docs: DataFrame, samples: list[dict], key: str, text: str, fields: Column | None = None) -> DataFrame:
    """JON-24, FN-63: the best sample of each document: .35 of the labels', .35 of the grams' weight and .3 of the fields it has.
    Samples (id, labels, grams, fields) are few and literal; of equal scores the first stays."""
    body = F.coalesce(F.col(text), F.lit(""))
    names = F.array().cast("array<string>") if fields is None else fields

    def share(weights: dict[str, int]) -> Column:
        total = sum(weights.values())
        hit = [F.when(F.contains(body, F.lit(w)), n).otherwise(0) for w, n in weights.items()]
        return sum(hit[1:], hit[0]).cast("decimal(18,8)") / total if total else F.lit(0).cast("decimal(18,8)")

    scored = []
    for k, s in enumerate(samples):
        anchor = F.size(F.array_intersect(names, F.array(*map(F.lit, s["fields"])))).cast("decimal(18,8)") / len(s["fields"]) if s.get("fields") else F.lit(0).cast("decimal(18,8)")
        a, b, c = (F.lit(str(w)).cast("decimal(4,2)") for w in config.SAMPLE_WEIGHTS)
        score = F.round(share(s.get("labels", {})) * a + share(s.get("grams", {})) * b + anchor * c, 4).cast("decimal(6,4)")
        scored.append(F.struct(score.alias("score"), F.lit(-k).alias("first"), F.lit(s["id"]).alias("sample_id")))
    if not scored:
        return docs.select(key, F.lit(0).cast("decimal(6,4)").alias("score"), F.lit(None).cast("int").alias("sample_id"))
    best = F.array_max(F.array(*scored))
    return docs.select(key, best["score"].alias("score"), F.when(best["score"] >= config.SAMPLE_THRESHOLD, best["sample_id"]).alias("sample_id"))


def label_counts(docs: DataFrame, key: str, text: str, words: list[str] = config.LABEL_WORDS) -> DataFrame:
    """AGG-31: the label words of each document with their numbers."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = F.array(*[F.struct(F.lit(w).alias("word"), count_in(body, F.lit(w)).alias("n")) for w in words])
    return docs.select(key, F.inline(F.filter(rows, lambda r: r["n"] > 0)))


def template_match(docs: DataFrame, templates: DataFrame, key: str, kind: str, fields: str) -> DataFrame:
    """JON-25: the first template (by usage descending, then id) of a document's type whose required fields it has."""
    hits = docs.join(templates.filter("enabled").withColumnRenamed("document_type", kind), kind)
    hits = hits.filter(F.size(F.array_except("require_fields", F.col(fields))) == 0)
    return hits.groupBy(key).agg(F.min_by("template_id", F.struct(-F.col("usage_count"), F.col("template_id"))).alias("template_id"))


def learned(old: Column, new: Column) -> Column:
    """SET-05: the sorted union of field names."""
    return F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))))


def learned_sample(docs: DataFrame, key: str, text: str, words: list[str] = config.LABEL_WORDS, letters: str = r"[\x{4e00}-\x{9fff}]", stop: str = config.STOP_CHARS, most: int = 200) -> DataFrame:
    """UDF-10: what a sample document teaches: its label words and its frequent grams with their numbers, as maps for sample_scores().
    Texts go to tasks of SAMPLES documents, where their grams are counted and ranked, so that these aren't shuffled and a task holds those of
    as many documents whatever the input."""
    docs = docs.select(key, text).repartition(docs.count() // SAMPLES + 1, key)
    of = lambda name, k: F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, F.col("n").cast("int"))))).alias(name)
    labels = label_counts(docs, key, text, words).groupBy(key).agg(of("labels", "word"))
    grams = bigrams(docs, [key], text, letters, stop, 2, most).groupBy(key).agg(of("grams", "gram"))
    empty = F.create_map().cast("map<string,int>")
    return docs.select(key).join(labels, key, "left").join(grams, key, "left").select(key, F.coalesce("labels", empty).alias("labels"), F.coalesce("grams", empty).alias("grams"))
