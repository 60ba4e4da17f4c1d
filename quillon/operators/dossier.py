"""Dossiers: files of a business, completeness, links, fuzzy guard, company repair (JON-02, JON-03, JON-20, JON-21, JON-22, JON-31, AGG-21, AGG-24 to AGG-26)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.similarity import ratio
from ..functions.text import business_no, chars_differ, is_business_no, norm_company
from ..sources.shared import written


def dossier_list(records: DataFrame, files: DataFrame, status: str | None = None, kind: str | None = None, keyword: str | None = None) -> DataFrame:
    """FLT-09, JON-31, AGG-25: records with the number of their files and their roles."""
    own = files.groupBy("business_id").agg(F.count("*").alias("n_files"), F.array_join(F.array_sort(F.collect_set("file_role")), ",").alias("roles"))
    rows = records
    if status:
        rows = rows.filter(F.col("status") == status)
    if kind:
        rows = rows.filter(F.col("business_type").ilike(f"%{kind}%"))
    if keyword:
        like = [F.col(c).ilike(f"%{keyword}%") for c in ("business_no", "title", "ship_name", "counterparty") if c in records.columns]
        test = like[0]
        for t in like[1:]:
            test = test | t
        rows = rows.filter(test)
    return rows.join(own, rows["id"] == own["business_id"], "left").drop("business_id").withColumns({"n_files": F.coalesce("n_files", F.lit(0)), "roles": F.coalesce("roles", F.lit(""))})


def completeness(files: DataFrame, key: str = "business_id", role: str = "file_role", expected: list[str] = config.EXPECTED_ROLES) -> DataFrame:
    """AGG-24, SET-04: which of the expected roles a dossier has and lacks, in percent."""
    have = F.collect_set(role)
    want = F.array(*map(F.lit, expected))
    rows = files.groupBy(key).agg(have.alias("_have"))
    missing = F.array_except(want, F.col("_have"))
    return rows.select(
        key,
        F.array_join(F.array_sort(F.array_intersect(F.col("_have"), want)), ",").alias("present"),
        F.array_join(F.array_sort(missing), ",").alias("missing"),
        F.round((len(expected) - F.size(missing)) * 100.0 / len(expected), 0).cast("int").alias("percent"),
    )


def first_link(files: DataFrame, entity: str = "document_id") -> DataFrame:
    """WIN-03: the first dossier of each document."""
    return files.groupBy(entity).agg(F.min_by("business_id", F.struct("created_at", "business_id")).alias("business_id"))


#: Characters up to which numbers are compared by what is left of them, and different lengths of which each has a bound of its own.
SHORT, LENGTHS = 40, 200
#: Numbers whose texts a task makes; each has some hundreds.
SPREAD = 2000


def without(text: Column, most: int) -> Column:
    """The texts that are left of a text without up to `most` of its characters, itself included, each once."""
    out = F.array(text)
    for _ in range(most):
        at = lambda v: F.sequence(F.lit(1), F.char_length(v))
        cut = lambda v: F.transform(at(v), lambda k: F.concat(F.substr(v, F.lit(1), k - 1), F.substr(v, k + 1)))  # noqa: B023, E731
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(F.filter(out, lambda v: F.char_length(v) > 0), cut))))
    return out


def spread(numbers: DataFrame) -> DataFrame:
    """Numbers over as many tasks as they need: a small file of them would be one task's, with all their texts."""
    return numbers.repartition(numbers.count() // SPREAD + 1)


def top_two(asked: DataFrame, known: DataFrame, key: str, least: float, gap: float, near: int = 2, block: int = 2000) -> DataFrame:
    """WIN-09: key, known_no, score and next of the two most similar known numbers of each asked one (`_norm` and `_known`), exactly as if all
    were compared, as far as the outcome asks for it: a score of `least` or more, and whether the next is closer than `gap`.

    Numbers that share all but k characters of the longer one, in their order, have a text in common when k characters are left out
    of either; so a join on these texts finds all of them, k from 1 to `near`.  What it hasn't found has at most so many
    matching characters, which bounds its score.  A number is settled if what it hasn't seen can't change its outcome.  The few that
    are left, which nothing is near to, are compared with all known ones, in blocks, whose rows give their two best alone;
    numbers of common characters bound the score, so that most pairs are not compared in full."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "known_no")
    best = lambda df: df.withColumn("next", F.lead("score").over(w)).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    out, open_ = None, asked.select(key, "_norm")
    sizes = sorted(r[0] for r in known.select(F.char_length("_known")).distinct().limit(LENGTHS + 1).collect())
    for k in range(1, near + 1):
        left = spread(open_.filter(F.char_length("_norm") <= SHORT)).withColumn("_text", F.explode(without(F.col("_norm"), k)))
        right = spread(known.filter(F.char_length("_known") <= SHORT + k)).withColumn("_text", F.explode(without(F.col("_known"), k)))
        pairs = left.join(right, "_text").select(key, "_norm", "known_no", "_known").distinct()
        found = best(pairs.withColumn("score", ratio("_norm", "_known")))
        found = open_.select(key, F.char_length("_norm").alias("_size")).join(found.drop("_norm", "_known"), key, "left")
        # An unseen number of n characters lacks more than k of the longer of both, which bounds what can match.
        size, bound = F.col("_size"), lambda n: 2.0 * F.least(F.col("_size"), n, F.greatest(F.col("_size"), n) - k - 1) / (F.col("_size") + n)  # noqa: B023, E731
        unseen = 2.0 * size / (2 * size + k + 1) if len(sizes) > LENGTHS else F.greatest(F.lit(0.0), F.lit(0.0), *[bound(F.lit(n)) for n in sizes])
        unseen = F.when(size <= SHORT, unseen).otherwise(1.0)
        settled = (F.col("score") > unseen) & ((F.col("score") - unseen >= gap) | F.coalesce(F.col("score") - F.col("next") < gap, F.lit(False)))
        done = written(found.withColumn("_done", F.coalesce((settled & (F.col("score") >= least)) | (unseen < least) & F.coalesce(F.col("score") < least, F.lit(True)), F.lit(False))), "two-best")
        part = done.filter("_done AND score IS NOT NULL").select(key, "known_no", "score", "next")
        out = part if out is None else out.unionByName(part)
        open_ = open_.join(done.filter("_done").select(key), key, "left_anti")
    open_ = written(open_, "far-numbers")
    left = open_.count()
    if left and sizes:
        parts = known.count() // block + 1
        a = open_.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        b = known.withColumn("_part", F.pmod(F.xxhash64("known_no"), F.lit(parts)).cast("int"))
        kind = asked.schema[key].dataType.simpleString()
        far = a.groupBy("_part").cogroup(b.groupBy("_part")).applyInPandas(two_best(key, least - gap), f"`{key}` {kind}, known_no string, score double")
        out = best(far).select(key, "known_no", "score", "next") if out is None else out.unionByName(best(far).select(key, "known_no", "score", "next"))
    return out


def two_best(key: str, least: float):
    """Of a block of known numbers the two best for each asked one."""

    def block(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        out = []
        if len(asked) and len(known):
            letters = sorted({c for t in (*asked["_norm"], *known["_known"]) for c in t})
            count = lambda texts: np.array([[t.count(c) for c in letters] for t in texts], np.int16).reshape(len(texts), len(letters))
            theirs, sizes = count(known["_known"]), known["_known"].str.len().to_numpy()
            names, numbers = known["known_no"].tolist(), known["_known"].tolist()
            for own, norm, mine in zip(asked[key], asked["_norm"], count(asked["_norm"]), strict=True):
                bound = 2.0 * np.minimum(theirs, mine).sum(axis=1) / np.maximum(sizes + len(norm), 1)
                two: list[tuple[float, str]] = []
                for k in np.argsort(-bound, kind="stable"):
                    if bound[k] < least or (len(two) == 2 and bound[k] < -two[1][0]):
                        break
                    two = sorted([*two, (-SequenceMatcher(None, norm, numbers[k]).ratio(), names[k])])[:2]
                out += [(own, name, -score) for score, name in two]
        return pd.DataFrame(out, columns=[key, "known_no", "score"])

    return block


def fuzzy_guard(asked: DataFrame, known: DataFrame, number: str, key: str, least: float = config.FUZZY_LEAST, gap: float = config.FUZZY_GAP) -> DataFrame:
    """JON-20, WIN-09: exact number (linked), else the same normal form (linked), else the most similar number: `similar` if it's at
    least .75 like it (a person decides), `ambiguous` if the next is less than .08 behind, else `new` if it's a valid business number.
    No number is left out of the comparison; see top_two()."""
    norm = business_no(F.col(number))
    a = asked.select(F.col(key), F.col(number).alias("_no"), norm.alias("_norm"))
    k = known.select(F.col(number).alias("known_no"), norm.alias("_known")).distinct()
    exact = a.join(k, a["_norm"] == k["_known"]).groupBy(key).agg(F.min_by("known_no", F.struct((F.col("known_no") != F.col("_no")), "known_no")).alias("known_no"))
    rest = a.join(exact.select(key), key, "left_anti")
    # Numbers that are asked for often are compared once; blank ones are like nothing.
    each = written(rest.filter("_norm <> ''").select("_norm").distinct(), "asked-numbers")
    best = top_two(each.select(F.col("_norm").alias("_own"), "_norm"), written(k, "known-numbers"), "_own", least, gap).filter(F.col("score") >= least)
    near = rest.join(best, rest["_norm"] == best["_own"]).select(key, F.when(F.col("score") - F.coalesce("next", F.lit(0.0)) < gap, "ambiguous").otherwise("similar").alias("outcome"), "known_no", "score")
    linked = exact.select(key, F.lit("linked").alias("outcome"), "known_no", F.lit(1.0).alias("score"))
    done = linked.unionByName(near)
    other = a.join(done.select(key), key, "left_anti").select(key, F.when(is_business_no(F.col("_no")), "new").otherwise("invalid").alias("outcome"), F.lit(None).cast("string").alias("known_no"), F.lit(None).cast("double").alias("score"))
    return done.unionByName(other)


def backfill_stats(outcomes: DataFrame) -> DataFrame:
    """AGG-26."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def top_companies(fields: DataFrame, names: list[str], most: int = 200) -> DataFrame:
    """AGG-21, SRT-05: the most frequent values of company fields; ties by name."""
    rows = fields.filter(F.col("field_name").isin(*names) & (F.coalesce("field_value", F.lit("")) != ""))
    return rows.groupBy(F.col("field_value").alias("company")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "company").limit(most)


def company_fix(candidates: DataFrame, known: DataFrame, name: str, known_name: str, q: int = 2, least: float = 0.85) -> DataFrame:
    """JON-21: for each distinct candidate the most similar known name, from .85 to below 1, lengths alike.  Names this similar share
    a pair of neighbouring characters, on which candidates and known names are joined; equal pairs of names are compared once."""

    def grams(df: DataFrame, c: str, as_: str) -> DataFrame:
        rows = df.select(F.col(c).alias(as_), norm_company(F.col(c)).alias(f"_{as_}")).distinct().filter(F.char_length(f"_{as_}") >= q)
        at = F.sequence(F.lit(1), F.char_length(f"_{as_}") - q + 1)
        return rows.select(as_, f"_{as_}", F.explode(F.array_distinct(F.transform(at, lambda i: F.substr(F.col(f"_{as_}"), i, F.lit(q))))).alias("_gram"))

    pairs = grams(candidates, name, "candidate").join(grams(known, known_name, "best"), "_gram").select("candidate", "_candidate", "best", "_best").distinct()
    n, m = F.char_length("_candidate"), F.char_length("_best")
    pairs = pairs.filter(F.abs(n - m) <= F.greatest(F.lit(3), F.floor(n / 3))).withColumn("score", ratio("_candidate", "_best"))
    good = pairs.filter((F.col("score") >= least) & (F.col("score") < 1))
    return good.groupBy("candidate").agg(F.max_by("best", F.struct("score", "best")).alias("best"), F.max("score").alias("score"))


def fuzzy_types(keyword: str, types: DataFrame, kind: str = "type") -> DataFrame:
    """JON-22: the types that hold the keyword, differ from it in one character (two to six long), or are .7 like it."""
    key = F.lit(keyword)
    one = F.char_length(kind).between(2, 6) & (F.coalesce(chars_differ(F.col(kind), key), F.lit(99)) == 1)
    return types.select(kind).distinct().filter(F.contains(F.lower(kind), F.lower(key)) | one | (ratio(F.col(kind), key) >= 0.7))


def linked(documents: DataFrame, records: DataFrame, number: str = "contract_no") -> DataFrame:
    """JON-36, DML-04: links of documents to records of the same normal number."""
    a = documents.select("document_id", "file_role", business_no(F.col(number)).alias("_no"))
    return a.join(records.select(F.col("id").alias("business_id"), business_no(F.col("business_no")).alias("_no")), "_no").select("business_id", "document_id", "file_role")


def new_dossiers(documents: DataFrame, known: DataFrame, number: str = "contract_no") -> DataFrame:
    """DML-05: records for valid numbers that have none, with the first values of their documents."""
    rows = documents.filter(is_business_no(F.col(number))).withColumn("_no", business_no(F.col(number)))
    rows = rows.join(known.select(business_no(F.col("business_no")).alias("_no")), "_no", "left_anti")
    return rows.groupBy("_no").agg(F.min_by(number, "document_id").alias("business_no"), F.min_by("vessel", F.when(F.col("vessel").isNotNull(), F.col("document_id"))).alias("ship_name"), F.count("*").alias("n_documents")).drop("_no")



def unlinked(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """DML-04: the links without those asked for (business_id, document_id)."""
    return files.join(pairs.select("business_id", "document_id").distinct(), ["business_id", "document_id"], "left_anti")


def dissolved(records: DataFrame, files: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DML-04: records and links without the dossiers asked for; their documents stay."""
    gone = ids.select("id").distinct()
    return records.join(gone, "id", "left_anti"), files.join(gone.withColumnRenamed("id", "business_id"), "business_id", "left_anti")


def documents_of(files: DataFrame, docs: DataFrame, records: DataFrame) -> DataFrame:
    """JON-02, JON-03: each link with its record's number and its document's columns."""
    own = files.join(records.select(F.col("id").alias("business_id"), "business_no"), "business_id")
    return own.join(docs.withColumnRenamed("id", "document_id"), "document_id")
