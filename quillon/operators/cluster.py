"""Groups of documents and near-identical fingerprints (AGG-34, JON-26, JON-27, FLT-17, SRT-04)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config
from ..functions.hashing import as_bits
from ..sources.shared import scratch, written
from .skew import group_counts


def valid_company(name: Column, stop: list[str] = config.NOT_COMPANIES) -> Column:
    """FLT-17: four characters or more, none of the stop substrings, and not digits and signs alone."""
    own = F.trim(F.coalesce(name, F.lit("")))
    ok = (F.char_length(own) >= 4) & ~own.rlike(r"(?U)^[\d\s\W]+$")
    for word in stop:
        ok = ok & ~F.contains(own, F.lit(word))
    return ok


def cascading_groups(docs: DataFrame, key: str, contract: Column, kind: Column, company: Column, content: Column, unnamed: list[str] = ("其他", "未识别")) -> DataFrame:
    """AGG-34: group_key of each document: its contract number, else its type if two or more are left, else its company, else type
    and content if two or more are left, else itself.  Each count is over what the steps before have left, as the code of
    the original does it (quirk Q6: its documentation names another order)."""
    rows = docs.select(F.col(key), *[F.trim(F.coalesce(c, F.lit(""))).alias(n) for n, c in (("_no", contract), ("_type", kind), ("_firm", company), ("_body", content))], valid_company(company).alias("_ok"))
    done = F.when(F.col("_no") != "", F.concat(F.lit("contract:"), F.col("_no")))
    rows = rows.withColumn("_done", done)

    rows = written(rows, "grouping")

    def step(rows: DataFrame, by: list[str], ok: Column, least: int, label: Column) -> DataFrame:
        open_ = F.col("_done").isNull() & ok
        keyed = rows.withColumn("_by", F.concat_ws("\x00", *by) if len(by) > 1 else F.col(by[0]))
        counted = group_counts(keyed, "_by", key, open_)
        return counted.withColumn("_done", F.coalesce("_done", F.when(open_ & (F.col("_n") >= least), label))).drop("_n", "_by")

    rows = step(rows, ["_type"], (F.col("_type") != "") & ~F.col("_type").isin(*unnamed), 2, F.concat(F.lit("type:"), F.col("_type")))
    rows = rows.withColumn("_done", F.coalesce("_done", F.when(F.col("_ok"), F.concat(F.lit("company:"), F.col("_firm")))))
    rows = step(written(rows, "grouping"), ["_type", "_body"], F.col("_body") != "", 2, F.concat(F.lit("tpl:"), F.col("_type"), F.lit(":"), F.substring("_body", 1, 6)))
    return rows.select(key, F.coalesce("_done", F.concat(F.lit("single:"), F.col(key).cast("string"))).alias("group_key"))


#: Candidates that a fingerprint may expect in a key, before keys of more bits are taken.
MEET = 8


def near_pairs(prints: DataFrame, key: str, fingerprint: str, limit: int = config.SIMHASH_LIMIT, most_blocks: int = 4) -> DataFrame:
    """Pairs (a < b) of ids whose 64-bit hex fingerprints differ in `limit` bits or fewer, with their distance.  Equal
    fingerprints meet once, as one row each.  Cut into limit + t blocks, two others are equal in at least t of them, so each
    choice of t blocks is a key; t grows with the number of fingerprints, as longer keys leave fewer candidates.  Returns
    links between the smallest ids of distinct fingerprints."""
    rows = prints.select(F.col(key).alias("id"), as_bits(F.col(fingerprint)).alias("bits")).filter("bits IS NOT NULL")
    rows = written(rows.groupBy("bits").agg(F.min("id").alias("id")), "prints")
    n, t = rows.count(), 1
    while t < most_blocks and n / 2 ** (64 * t / (limit + t)) > MEET:
        t += 1
    cuts = [64 * k // (limit + t) for k in range(limit + t + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    masks = [signed(sum(own)) for own in combinations(block, t)]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("bits").bitwiseAND(F.lit(m)).alias("part")) for k, m in enumerate(masks)])
    keyed = rows.select("id", "bits", F.inline(keys))
    left, right = keyed.alias("l"), keyed.alias("r")
    pairs = left.join(right, (F.col("l.k") == F.col("r.k")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.id") < F.col("r.id")))
    apart = F.col("l.bits").bitwiseXOR(F.col("r.bits"))
    # a pair counts at its first key alone
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(k)) for k, m in enumerate(masks)])
    pairs = pairs.filter((F.bit_count(apart) <= limit) & (first == F.col("l.k")))
    return pairs.select(F.col("l.id").alias("a"), F.col("r.id").alias("b"), F.bit_count(apart).alias("distance"))


def leader_clusters(prints: DataFrame, key: str, layout: str, fingerprint: str, limit: int = config.SIMHASH_LIMIT) -> DataFrame:
    """JON-26: by ascending id a document joins the first leader with its layout hash or within `limit` bits, or leads a new
    cluster.  So it leads unless a neighbour of a smaller id does: in each round the documents lead that have no smaller open
    neighbour, and their neighbours are closed.  Documents of the same layout and fingerprint are one node, and a layout is
    a node's group, never a list of pairs."""
    with scratch(prints.sparkSession) as keep:
        rows = prints.select(F.col(key).cast("long").alias("id"), F.nullif(F.col(layout), F.lit("")).alias("layout"), F.when(F.char_length(fingerprint) == 16, F.col(fingerprint)).alias("print"))
        lone = F.col("layout").isNull() & F.col("print").isNull()
        # nodes without layout and fingerprint are by themselves
        named = rows.filter(~lone).select("id", F.concat_ws("/", F.coalesce("layout", F.lit("-")), F.coalesce("print", F.lit("-"))).alias("own"), "layout", "print")
        nodes = keep(named.groupBy("own").agg(F.min("id").alias("node"), F.first("layout").alias("layout"), F.first("print").alias("print")), "nodes")
        prints_ = nodes.filter("print IS NOT NULL").select(F.col("node").alias("id"), "print")
        reps = prints_.groupBy("print").agg(F.min("id").alias("rep"))
        links = near_pairs(prints_, "id", "print", limit).select("a", "b")
        links = links.union(links.select("b", "a")).union(reps.select("rep", "rep"))
        of = prints_.join(reps, "print").select("id", "rep")
        edges = links.join(of.withColumnsRenamed({"id": "u", "rep": "a"}), "a").join(of.withColumnsRenamed({"id": "v", "rep": "b"}), "b")
        edges = keep(edges.filter("u < v").select("u", "v"), "edges")
        open_, leaders = nodes.select("node", "layout"), nodes.select("node", "layout").limit(0)
        while not open_.isEmpty():
            waits = edges.join(open_.select(F.col("node").alias("u")), "u").join(open_.select(F.col("node").alias("v")), "v").select("v").distinct()
            least = open_.filter("layout IS NOT NULL").groupBy("layout").agg(F.min("node").alias("first"))
            new = open_.join(waits.withColumnRenamed("v", "node"), "node", "left_anti").join(least, "layout", "left")
            new = keep(new.filter("layout IS NULL OR node = first").select("node", "layout"), "leaders")
            closed = edges.join(new.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"))
            left = open_.join(closed.union(new.select("node")).distinct(), "node", "left_anti")
            led = new.filter("layout IS NOT NULL").select("layout", F.col("node").alias("first"))
            left = left.join(led, "layout", "left").filter("first IS NULL OR node < first").select("node", "layout")
            open_, leaders = keep(left, "open"), leaders.union(new)
        leaders = keep(leaders, "leaders")
        by_print = edges.join(leaders.select(F.col("node").alias("u")), "u").select(F.col("v").alias("node"), F.col("u").alias("leader"))
        first = leaders.filter("layout IS NOT NULL").groupBy("layout").agg(F.min("node").alias("leader"))
        by_layout = nodes.select("node", "layout").join(first, "layout").filter("leader < node").select("node", "leader")
        found = leaders.select("node", F.col("node").alias("leader")).union(by_print.union(by_layout).join(leaders.select("node"), "node", "left_anti"))
        found = found.groupBy("node").agg(F.min("leader").alias("leader")).join(nodes.select("node", "own"), "node")
        out = named.join(found, "own").select("id", "leader").union(rows.filter(lone).select("id", F.col("id").alias("leader")))
        return written(out, "leaders")


def same_image(a: DataFrame, key: str, limit: int = config.DHASH_LIMIT, tolerance: str = config.TOLERANCE, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """JON-27: pictures of one size whose hashes differ in a bit or less and whose amounts don't contradict, as (members, pairs).
    members: id and class_id, the smallest id with the same hash, size and amount; all of a class are the same picture to each other.
    pairs (a < b): classes that are.  So equal pictures are a row each, and not pairs.  With `by` only pictures that have these columns
    in common are compared.  columns: key, phash, img_w, img_h, amount."""
    by = by or []
    bits = as_bits(F.col("phash"))
    rows = a.filter(bits.isNotNull() & F.col("img_w").isNotNull() & F.col("img_h").isNotNull()).select(F.col(key).alias("id"), *by, bits.alias("bits"), "img_w", "img_h", "amount")
    own = [*by, "bits", "img_w", "img_h", "amount"]
    if by:
        # Groups are small: each row goes to its group once, a class is the row that names it, and the only one of a group meets no other.
        group = Window.partitionBy(*by)
        rows = rows.repartition(*by).withColumn("class_id", F.min("id").over(Window.partitionBy(*own)))
        rows = rows.withColumn("_alone", F.min("class_id").over(group) == F.max("class_id").over(group))
        members = written(rows, "image-members")
        classes = members.filter("id = class_id AND NOT _alone").drop("id", "_alone")
        members = members.select("id", "class_id", *by)
    else:
        classes = rows.groupBy(*own).agg(F.min("id").alias("class_id"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in own]
        members = rows.alias("r").join(classes.alias("c"), same).select("r.id", "class_id")
    cuts = [64 * k // (limit + 1) for k in range(limit + 2)]
    bands = F.array(*[F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(F.col("bits"), x).bitwiseAND(F.lit((1 << (y - x)) - 1)).alias("part")) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))])
    keyed = classes.select("class_id", *own, F.inline(bands))
    x, y = keyed.alias("x"), keyed.alias("y")
    meet = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in (*by, "img_w", "img_h", "band", "part")]
    clash = F.abs(F.col("x.amount") - F.col("y.amount")) >= F.lit(tolerance).cast("decimal(18,2)")
    pairs = x.join(y, meet).filter((F.col("x.class_id") < F.col("y.class_id")) & (F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= limit) & ~F.coalesce(clash, F.lit(False)))
    return members, pairs.select(F.col("x.class_id").alias("a"), F.col("y.class_id").alias("b"), *[F.col(f"x.{c}").alias(c) for c in by]).distinct()


def image_leaders(docs: DataFrame, key: str, by: list[str]) -> DataFrame:
    """id, kept_id and `by` of pictures, by ascending id within `by`: each is kept, or is a copy of the first kept one that is the same
    picture.  A class is decided once: at once if no other is near to it, else in rounds.  One without an undecided smaller neighbour is
    kept, and its neighbours are copies; a round decides at least the first class of each chain, so rounds grow with chains of pictures
    a bit apart, not with copies."""
    with scratch(docs.sparkSession) as keep:
        members, pairs = same_image(docs, key, by=by)
        edges = keep(pairs.select("a", "b"), "image-pairs")
        open_, kept = keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "image-open"), None
        while not open_.isEmpty():
            waits = edges.join(open_.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
            new = keep(open_.join(waits, "node", "left_anti"), "image-kept")
            copies = edges.join(new.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node")).distinct()
            open_, kept = keep(open_.join(new, "node", "left_anti").join(copies, "node", "left_anti"), "image-open"), new if kept is None else kept.union(new)
        if kept is None:
            return members.select("id", F.col("class_id").alias("kept_id"), *by)
        copies = edges.join(kept.select(F.col("node").alias("a")), "a", "left_semi").join(kept.select(F.col("node").alias("b")), "b", "left_anti")
        first = kept.select("node", F.col("node").alias("kept_id")).union(copies.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("kept_id")))
        first = written(first, "image-leaders")
    return members.join(first, F.col("class_id") == F.col("node"), "left").select("id", F.coalesce("kept_id", "class_id").alias("kept_id"), *by)
