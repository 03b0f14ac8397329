"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its size gets floor(r) certain copies of every document.  The rest of the
target is a sample without replacement of unequal probabilities: a document's inclusion probability grows with the
root of its length, scaled so that the expected words are those wanted, and documents are
ranked by their random odds divided by their inclusion odds (Rosén, 1997).  The sample has a fixed size
in words: ranks are taken while the middle of the next document lies below what is left of the target,
so a source misses its target by half a document at most.

Ranks are cut without sorting a source: two levels of bucket counts over the ranks' logarithm narrow the cut to
about three documents in ten thousand, whatever the probabilities, and only those are sorted.  A source that wants whole copies
only takes no part in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wayframe.llm.common import packed, running, settle, unpacked

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
BUCKETS = 256
#: Logarithms of ranks that are told apart; beyond, ranks share the outermost bucket.
SPAN = 40.0
SEED = "mix-1"


def draw(doc_id: Column, th: Column) -> Column:
    """A number in (0, 1) from the doc_id and the text's digest: the same in every run, and in DuckDB."""
    key = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), th)
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def liking(size: Column) -> Column:
    """What a document's inclusion probability is in proportion to: the whole root of its words, a whole number so that sums are exact."""
    return F.greatest(F.floor(F.sqrt(size.cast("double"))), F.lit(1)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets per source from (source, source_size): weights repeat over the sources by code point, null last.

    The total, share times all sizes, is dealt by weight; a source above cap times its size stops there
    and its excess is reshared by weight.  Sorted by cap per weight, the capped sources come first, and
    the level (target per weight) of the others follows from running totals.
    """
    ranked = running(sizes.withColumns({"no": F.col("source").isNull(), "one": F.lit(1).cast("bigint")}), ["no", "source"], ["one"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("before_one") % len(weights) + 1).cast("int"))
    w = ranked.select("source", "no", "source_size", weight.alias("w")).withColumns({"most": cap * F.col("source_size"), "ratio": cap * F.col("source_size") / F.col("w")})
    w = running(w, ["ratio", "no", "source"], ["most", "w"])
    whole = w.agg(F.sum("w").alias("all_w"), (share * F.sum("source_size")).alias("all_words"))
    level = (F.col("all_words") - F.col("before_most")) / (F.col("all_w") - F.col("before_w"))
    one = F.lit(1)
    w = w.withColumn("k", one).join(whole.withColumn("k", one), "k").withColumn("level", level)
    least = w.where("ratio >= level").agg(F.max("level").alias("found")).withColumn("k", one)
    w = w.join(least, "k").withColumn("target", F.when(F.col("found").isNull(), F.col("most")).otherwise(F.least("most", F.col("found") * F.col("w"))))
    return w.select("source", "source_size", "target")


def copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and ``copies`` to rows with doc_id, source, size, liking, th; plan has the sums of liking * size, too."""
    p = plan.select(F.col("source").alias("_source"), "source_size", "target", "liked")
    p = p.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    p = p.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    every = settle(sized.join(p, F.col("source").eqNullSafe(F.col("_source"))), "mix")
    d = every.where("rest > 0")
    chance = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("rest") * F.col("liking") / F.greatest("liked", F.lit(1))))
    u = draw(F.col("doc_id"), F.col("th"))
    q = (u / (1 - u)) / (chance / (1 - chance))
    d = d.withColumn("q", q).withColumn("at", F.least(F.greatest((F.ln("q") + SPAN) / (2 * SPAN), F.lit(0.0)), F.lit(1.0)))
    b1 = F.least(F.floor(F.col("at") * BUCKETS), F.lit(BUCKETS - 1))
    b2 = F.least(F.floor((F.col("at") * BUCKETS - b1) * BUCKETS), F.lit(BUCKETS - 1))
    d = settle(d.withColumns({"b1": b1, "b2": b2}), "mix")

    def cut(rows: DataFrame, b: str, base: Column) -> DataFrame:
        """Per source the first bucket whose end passes the rest, and the words before it."""
        h = rows.groupBy("_source", b).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first(base).alias("base"))
        up = F.sum("n").over(Window.partitionBy("_source").orderBy(b)) + F.col("base")
        h = h.withColumn("upto", up).where("upto > rest")
        return h.groupBy("_source").agg(F.min(F.struct(b, F.expr("upto - n").alias("before"))).alias("x")).select(F.col("_source").alias("_c"), F.col(f"x.{b}").alias(f"cut_{b}"), F.col("x.before").alias(f"before_{b}"))

    same = F.col("_source").eqNullSafe(F.col("_c"))
    first = settle(cut(d, "b1", F.lit(0).cast("bigint")), "cut")
    d1 = d.join(first, same, "left").drop("_c")
    second = settle(cut(d1.where("b1 = cut_b1"), "b2", F.col("before_b1")), "cut")
    d2 = d1.join(second, same, "left").drop("_c")
    inside = F.expr("b1 = cut_b1 AND b2 = cut_b2")
    order = Window.partitionBy("_source").orderBy("q", F.col("doc_id").asc_nulls_last(), "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    edge = d2.where(inside).withColumn("taken", (F.col("before_b2") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2) < F.col("rest"))
    sure = d2.where(~F.coalesce(inside, F.lit(False))).withColumn("taken", F.expr("cut_b1 IS NULL OR b1 < cut_b1 OR (b1 = cut_b1 AND b2 < cut_b2)"))
    none = every.where("NOT rest > 0").withColumn("taken", F.lit(False))
    out = sure.unionByName(edge).select(none.columns).unionByName(none)
    return out.withColumn("copies", (F.col("whole") + F.col("taken").cast("int")).cast("bigint")).drop("_source", "whole", "rest", "taken", "liked", "liking")


def mix(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of documents (doc_id, text, source): size, source_size, target, taken, copies.

    size is the number of words, 0 for a null text; such documents are worth no words, whether taken or not.
    Null sources are one source, last in order.  Rows with the same doc_id and text have the same draw; such full
    duplicates are interchangeable.  Texts may be of any length.  Empty tables give empty results.
    ``keep`` lists further columns to carry.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    sized = settle(docs.select("doc_id", "source", *keep, size.alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("th")).withColumn("liking", liking(F.col("size"))), "sizes")
    sums = settle(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("liking") * F.col("size")).alias("liked")), "sums")
    liked = sums.select(F.col("source").alias("_s"), "liked")
    plan = targets(sums.select("source", "source_size"))
    plan = settle(plan.join(liked, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "targets")
    return copies(sized, plan).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of documents, each as often as it is taken, with their columns.

    Nulls, ties and empty texts are treated as in mix(); columns pass through, whatever they are called; an empty table gives none.
    Decisions meet the texts by (doc_id, source, text digest); full duplicates are told apart by their number.
    """
    key = ["doc", "src", "th"]
    got = mix(docs).groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_src"), F.col("th").alias("_th"))
    # full duplicates: the copies of all of them together, shared by the rows in turn
    got = settle(got.agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")), "taken")
    d = packed(docs, doc=F.col("doc_id"), src=F.col("source"), th=F.md5(F.coalesce("text", F.lit(""))))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    single = d.join(got.where("rows = 1"), same).select("row", F.col("copies").alias("times"))
    # A third of the rows may be one repeated row: their number comes from a running total, not from one group.
    # Written by themselves they are small where few rows repeat, so their join need not shuffle all texts again.
    many = d.join(settle(got.where("rows > 1"), "repeated"), same).select("row", *key, "copies", "rows", F.lit(1).cast("bigint").alias("one"), F.monotonically_increasing_id().alias("salt"))
    many = running(many, [*key, "salt"], ["one"])
    low = many.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min("before_one").alias("low"))
    many = many.join(low, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    turn = F.expr("copies div rows") + ((F.col("before_one") - F.col("low")) < F.expr("copies % rows")).cast("bigint")
    rows = single.unionByName(many.select("row", turn.alias("times"))).where("times > 0")
    return unpacked(rows.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))), docs.columns)


SQL = rf"""WITH s AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS th,
   (CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / {float(1 << 48)!r} AS u FROM documents),
b AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(greatest(CAST(floor(sqrt(size::DOUBLE)) AS BIGINT), 1) * size) AS BIGINT) AS liked FROM s GROUP BY source),
w AS (SELECT *, [{", ".join(f"{w}.0::DOUBLE" for w in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS w FROM b),
r AS (SELECT *, {CAP}::DOUBLE * source_size AS most, {CAP}::DOUBLE * source_size / w AS ratio FROM w),
v AS (SELECT *, ({SHARE}::DOUBLE * (SELECT sum(source_size) FROM r) - coalesce(sum(most) OVER o, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER o, 0)) AS level
   FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, liked, coalesce(least(most, (SELECT max(level) FROM v WHERE ratio >= level) * w), most) AS target FROM v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
c AS (SELECT *, target - whole * source_size AS rest FROM p),
h AS (SELECT s.*, c.source_size, c.target, c.whole, c.rest, least(1 - 1e-9::DOUBLE, greatest(1e-9::DOUBLE, rest * greatest(CAST(floor(sqrt(size::DOUBLE)) AS BIGINT), 1) / greatest(liked, 1))) AS chance FROM s JOIN c ON c.source IS NOT DISTINCT FROM s.source),
q AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS q FROM h),
n AS (SELECT *, whole + CASE WHEN rest > 0 AND coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS LAST, size, th ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, source, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM n"""
