"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target (its weight's share of all words, capped at a multiple of
its own words, the excess reshared). Each of its documents gets the whole part of
target / source words as certain copies. What is left of the target is a sample with
unequal probabilities: a document's inclusion probability is p = min(1, c * k), k the
binary digits of its size, so longer documents come in more often, and c is such that
the probabilities, weighed by size, add up to the rest. Documents are ranked by
(u / (1 - u)) / (p / (1 - p)), u a random number hashed from id and text, and taken in
that order until the source's remaining words are met as nearly as whole documents allow.

The cut of each source is found from sums over rank buckets, then from the rows of
one bucket; documents are not gathered by source, so a hot source stays spread out.
What is joined to the documents is one row a source.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a
source of its own, ordered last; rows with the same id, source and text are one unit (all
taken or all left); an empty table gives an empty result; other columns are kept, and
those named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rank buckets of a source. The rows of one bucket are sorted in one task: 1/4096 of a source.
BUCKETS = 4096
#: Sources up to which their rows are sent to the documents, and not the documents to them.
MAX_BROADCAST = 50_000
OUTPUT = ("size", "source_size", "target", "copies", "taken")


def uniform(ident: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) from 52 bits of MD5; equal in every engine that has MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, cap: float = 3.0, weights: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): water filling on one row a source.

    Sources by code point, null last, weigh 1..weights, repeating. With sources in order of
    cap * size / weight, those before the level are capped and the level is what is left
    divided by the weights that are left.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", (F.pmod(F.row_number().over(by_name) - 1, F.lit(weights)) + 1).cast("long"))
    ranked = ranked.withColumn("r", F.lit(cap) * F.col("source_size") / F.col("w"))
    by_r = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = by_r.rowsBetween(Window.unboundedPreceding, -1), by_r.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left / F.sum("w").over(after)).withColumn("at", F.row_number().over(by_r))
    fits = F.when(F.col("level") <= F.col("r"), F.struct("at", "level"))
    level = F.min(fits).over(everything)["level"]
    return ranked.select(
        "source", "source_size",
        F.least(F.lit(cap) * F.col("source_size"), level * F.col("w")).cast("double").alias("target"),
    )


def inclusion(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with c from the words of each (source, k): a document of class k is included with probability min(1, c * k); null without a rest.

    Water filling from the highest class down: those with c * k over 1 are certain, and c is
    what they leave, divided by the weights of the classes below.
    """
    t, k = targets.alias("t"), classes.alias("k")
    rows = k.join(t, F.col("k.source").eqNullSafe(F.col("t.source"))).filter("p > 0").select("t.source", "k", "words", "rest")
    above = Window.partitionBy("source").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("source", "k", "rest", F.coalesce(F.sum("words").over(above), F.lit(0)).alias("certain"), F.sum(F.col("k") * F.col("words")).over(upto).alias("weighed"))
    rows = rows.filter("weighed > 0").withColumn("c", (F.col("rest") - F.col("certain")) / F.col("weighed"))
    found = rows.filter("c * k <= 1").groupBy("source").agg(F.max_by("c", "k").alias("c")).alias("c")
    # A source in which rounding leaves no class takes all.
    c = F.when(F.col("p") > 0, F.coalesce("c.c", F.lit(1.0)))
    return t.join(found, F.col("t.source").eqNullSafe(F.col("c.source")), "left").select(*[F.col(f"t.{x}") for x in targets.columns], c.alias("c"))


def digits_of(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long")


def pareto_mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", cap: float = 3.0, seed: str = "mix") -> DataFrame:
    """docs with size, source_size, target, copies and taken (size * copies)."""
    docs = docs.select(*[c for c in docs.columns if c not in OUTPUT])
    words = F.coalesce(F.col(text).cast("string"), F.lit(""))
    u = uniform(F.concat(F.coalesce(F.col(ident).cast("string"), F.lit("")), F.lit(":"), F.md5(words.cast("binary"))), seed)
    size = common.n_words(F.col(text))
    light = common.cut(docs.select(F.col(ident).alias("id"), F.col(source).alias("source"), size.alias("size"), u.alias("u")))
    classes = common.cut(light.groupBy("source", digits_of(F.col("size")).alias("k")).agg(F.sum("size").alias("words")))
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), cap)
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(share)).withColumn("p", share - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = small(common.cut(inclusion(classes, targets)))

    # The bucket where a source's cumulative words reach what is left of its target.
    d, t = light.alias("d"), targets.select("source", "rest", "c").alias("t")
    ranked = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).filter("c IS NOT NULL")
    ranked = ranked.select("d.source", "id", "size", "rest", rank_key(F.col("u"), F.col("c"), F.col("size")).alias("q")).withColumn("bucket", rank_bucket(F.col("q")))
    summed = common.cut(ranked.groupBy("source", "bucket", "rest").agg(F.sum("size").alias("size")))
    upto = summed.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("bucket")))
    first = upto.filter(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"))).alias("x")).select("source", "x.*")
    first = small(common.cut(first))
    r, f = ranked.alias("r"), first.alias("f")
    edge = r.join(f, F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.bucket") == F.col("f.bucket")))
    edge = edge.select("r.source", "id", "size", "q", (F.col("rest") - F.col("before")).alias("rest"))
    # Equal rows are one unit; the document that crosses the cut is taken if that is nearer.
    edge = edge.groupBy("source", "q", "id", "rest").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("source").orderBy("q", "id")
    edge = edge.withColumn("upto", F.sum("size").over(order)).filter(F.col("upto") - F.col("size") / 2 < F.col("rest"))
    cuts = edge.groupBy("source").agg(F.max(F.struct("q", "id")).alias("last"))
    t, f, c = targets.alias("t"), first.select("source", "bucket").alias("f"), cuts.alias("c")
    plan = (
        t.join(f, F.col("t.source").eqNullSafe(F.col("f.source")), "left")
        .join(c, F.col("t.source").eqNullSafe(F.col("c.source")), "left")
        .select(F.col("t.source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"), F.col("t.c").alias("_c"), F.col("f.bucket").alias("_bucket"), F.col("c.last").alias("_last"))
    )
    plan = small(common.cut(plan))
    keyed = docs.withColumn("size", size).withColumn("_u", u)
    out = keyed.join(plan, keyed[source].eqNullSafe(plan["_source"])).withColumn("_q", rank_key(F.col("_u"), F.col("_c"), F.col("size")))
    key = F.struct(F.col("_q").alias("q"), F.col(ident).alias("id"))
    at = rank_bucket(F.col("_q"))
    inside = (at == F.col("_bucket")) & F.col("_last").isNotNull() & (key <= F.col("_last"))
    # Without a bucket the source's words don't reach the rest, by rounding: all are taken.
    more = F.when(F.col("_c").isNull(), 0).when(F.col("_bucket").isNull() | (at < F.col("_bucket")) | inside, 1).otherwise(0)
    out = out.withColumn("copies", (F.col("_whole") + more).cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*docs.columns, *OUTPUT)


def small(sources: DataFrame) -> DataFrame:
    """One row a source, sent to the documents if there are at most MAX_BROADCAST; else the join deals the documents out by source."""
    return F.broadcast(sources) if sources.count() <= MAX_BROADCAST else sources


def rank_key(u: Column, c: Column, size: Column) -> Column:
    """Random odds over inclusion odds; the lowest of these are the sample. Certain documents have 0."""
    p = c * digits_of(size)
    return F.when(c.isNull(), F.lit(None)).when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))


def rank_bucket(q: Column) -> Column:
    return F.floor(q / (1 + q) * BUCKETS).cast("int")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it had."""
    mixed = pareto_mix(docs)
    names = docs.columns
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*names)


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':mix'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
e AS (SELECT *, length(bin(size)) AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS r FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY r, source ASC NULLS LAST) AS nr,
         ((SELECT sum(source_size)::BIGINT FROM s)
          - 3.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w) OVER (ORDER BY r, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
  FROM r),
v AS (SELECT level FROM l WHERE level <= r ORDER BY nr LIMIT 1),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, (SELECT level FROM v) * w) AS target FROM l),
p AS (
  SELECT *, floor(target / source_size) AS whole, target / source_size - floor(target / source_size) AS p,
         target - floor(target / source_size) * source_size AS rest
  FROM t WHERE source_size > 0),
k AS (SELECT source, k, sum(size)::BIGINT AS words FROM e GROUP BY source, k),
m AS (
  SELECT p.source, k, rest,
         coalesce(sum(words) OVER (PARTITION BY p.source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS certain,
         (sum(k * words) OVER (PARTITION BY p.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS weighed
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source WHERE p > 0),
c AS (SELECT source, arg_max(c, k) AS c FROM (SELECT source, k, (rest - certain) / weighed AS c FROM m WHERE weighed > 0) WHERE c * k <= 1 GROUP BY source),
q AS (
  SELECT e.*, p.source_size, p.target, p.whole, p.rest, p.p,
         CASE WHEN c.c * k >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / ((c.c * k) / (1 - c.c * k)) END AS q
  FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source LEFT JOIN c ON e.source IS NOT DISTINCT FROM c.source),
o AS (SELECT *, CASE WHEN p > 0 THEN sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) END AS upto FROM q)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN p > 0 AND upto - size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
UNION ALL
SELECT doc_id, size, 0::BIGINT, 0.0::DOUBLE, 0::BIGINT FROM d WHERE source IN (SELECT source FROM s WHERE source_size = 0)
   OR (source IS NULL AND (SELECT max(source_size) FROM s WHERE source IS NULL) = 0)
"""
