"""How filters interact: for each order in which they may be applied, what each step removes and what others had removed before.

1. Each document becomes a mask of the filters that it fails, and masks become cells: one row for each part and mask with
   its numbers of documents.  Copies meet as counts, by digest, mask, part and labels, so a text that a third of all rows
   holds is a few rows.
2. The cells are unpivoted against the steps of all orders.  A running bit-or over the steps of a cell tells what has failed
   earlier; conditional sums over the cells and a window over the steps of a filter give the measures.

Null text counts as empty, a null part as the empty string.  The identity of a text is its SHA-256 and its length.  A document
with a null id has no smaller id and is smaller than none, so it is never a repetition; rows that repeat an id repeat it in
every count, and with the smallest id of their text none of them is a repetition.  Several labels of an id count as one that
is good, or toxic, if any is.  Other columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPACES = r"[\x20\x09-\x0D]+"
#: The letter of the filter that fails repetitions; it looks at the table, not at a text.
REPEATED = "E"


def failures(text: Column) -> dict[str, Column]:
    """Which filters of a single text fail it."""
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * capitals > 10 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bit k is set if the filter of the k-th letter fails), n, good and toxic: numbers of documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = failures(text)
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails.values())), F.lit(0))
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.concat_ws("/", F.sha2(text, 256), F.octet_length(text)).alias("digest"),
    )
    slim = slim.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("times"))
    # Null ids meet no label, and are dealt out by their texts.
    slim = slim.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("#"), "digest")))
    of = labels.groupBy(F.col("doc_id").cast("string").alias("key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = slim.join(of, "key", "left")

    # Of each text and each kind of row: how many there are, and how many of them hold its smallest id.
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "times")))
    no = F.lit(False)
    kinds = known.groupBy("digest", "mask", "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(
        F.sum("times").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("times")).otherwise(0)).alias("nameless"), first.alias("first")
    )
    least = F.min("first.id").over(Window.partitionBy("digest"))  # a row for each part and label of a text
    unique = F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.times")).otherwise(0)
    split = kinds.withColumn("unique", unique).select(
        "part",
        "good",
        "toxic",
        F.explode(
            F.array(
                F.struct(F.col("mask"), F.col("unique").alias("n")),
                F.struct((F.col("mask") + (1 << len(fails))).alias("mask"), (F.col("n") - F.col("unique")).alias("n")),
            )
        ).alias("cell"),
    )
    of_kind = lambda c: F.sum(F.when(F.col(c), F.col("cell.n")).otherwise(0))
    return split.filter("cell.n > 0").groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum("cell.n").alias("n"), of_kind("good").alias("good"), of_kind("toxic").alias("toxic"))


def steps(found: DataFrame, letters: str) -> DataFrame:
    """The cells against each step of each order: their columns, filter_order, step, filter, hit (the filter's bit if the
    cell fails it) and earlier (the bits of the filters that have failed it before)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    out = found.withColumn("filter_order", F.explode(orders))
    out = out.select("*", F.posexplode(F.split("filter_order", "")).alias("step", "filter")).withColumn("step", F.col("step") + 1)
    bit = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(letters) for x in (c, 1 << k)]), F.col("filter"))
    out = out.withColumn("bit", bit).withColumn("hit", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("earlier", F.coalesce(F.bit_or("hit").over(before), F.lit(0)))


def audit(found: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order and step with its measures; found has the columns of cells()."""
    long = steps(found, letters)
    alone, hit, gone = F.col("earlier") == 0, F.col("hit") != 0, F.col("earlier") != 0
    count = lambda what, c="n": F.sum(F.when(what, F.col(c)).otherwise(0))
    rows = long.groupBy("part", "filter_order", "step", "filter").agg(
        count(alone & ~hit).alias("kept"),
        count(alone & hit).alias("removed"),
        count(gone & hit).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"),
        count(alone & hit, "good").alias("good_lost"),
        count(alone & hit, "toxic").alias("toxic_lost"),
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter"))).drop("filter")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(cells(docs, labels), "ABCDE")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e
  FROM d
), l AS (
  SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1
), m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN translate(fails, before, '') <> fails AND contains(fails, f) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN translate(fails, before, '') = fails AND contains(fails, f) THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY 1, 2, 3, 4
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
