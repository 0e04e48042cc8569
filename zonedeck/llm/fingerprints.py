"""Document fingerprints: SimHash from DataFrame functions only.

Terms are pairs of neighbouring words, weighted by their bytes (at most MAX_WEIGHT);
each term's XXH64 votes on 64 signed bits with its weight. Votes are summed two bits a
number, so 32 sums and the total weight decide all bits.

Searches within a Hamming radius use permuted block tables: the bits are cut into
radius + PREFIX blocks, and each table is keyed by another choice of PREFIX of them, put
in front. Prints within the radius differ in `radius` blocks at most, so they agree in the
key of some table; with a radius of 3 that key has 31 to 33 bits, so few others do. A pair is
reported by the first table in which it meets.

The order of ids is found on (id, hash of the text) alone; the texts are dealt out once
by that key, and of the next document only the letters that are needed go to the one
before it.

Defined cases: null text is empty; a text without words has fingerprint zero; a null
id comes before all others; rows of one id are ordered by a hash of the text, and rows
equal in id and text have the same next document, the next different one; the next
document of an only one is itself; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAX_WEIGHT = 16
#: Documents that are put in order in one task, a few numbers each.
RANGE_ROWS = 50_000
#: Blocks of bits in the key of a permuted table.
PREFIX, RADIUS = 3, 3
_NULL_ID = -(2**63)
KEY = ["_k", "_h"]


def fingerprint_rows(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fp (signed 64 bits) of each row of texts that has words. Rows of equal keys are one."""
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    held = texts.select(*keys, words.alias("a"))
    zipped = held.select(*keys, F.explode(F.arrays_zip(F.col("a"), F.slice(F.col("a"), 2, F.greatest(F.size("a"), F.lit(1))).alias("b"))).alias("t"))
    a, b = F.col("t").getField("a"), F.col("t").getField("b")
    weight = F.least(F.octet_length(a) + F.coalesce(F.octet_length(b), F.lit(0)), F.lit(MAX_WEIGHT)).cast("long")
    votes = zipped.select(*keys, F.xxhash64(a, b).alias("h"), weight.alias("w"))
    two = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(two) * F.col("w")).alias(f"v{i}") for i in range(32)]
    summed = votes.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)
    low = [F.shiftleft((F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("w")).cast("long"), i) for i in range(32)]
    high = [F.shiftleft((F.shiftrightunsigned(f"v{i}", 32) * 2 > F.col("w")).cast("long"), i + 32) for i in range(32)]
    return summed.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), low + high).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)).cast("double") / 64


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _keyed(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(_k, _h, text): id and text hash, by which documents are ordered."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(ident).cast("long"), F.lit(_NULL_ID)).alias("_k"), F.xxhash64(content).alias("_h"), content.alias("text"))


def following(keyed: DataFrame) -> DataFrame:
    """(_k, _h, n_chars, _nk, _nh) of each different (_k, _h): the next one in order, cyclic. Checkpointed."""
    light = common.cut(keyed.select("_k", "_h", F.length("text").cast("long").alias("n_chars")).groupBy(*KEY).agg(F.max("n_chars").alias("n_chars")))
    parts = max(1, light.count() // RANGE_ROWS)
    ranged = common.cut(light.repartitionByRange(parts, *KEY).withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy(*KEY)
    placed = ranged.withColumn("next", F.lead(F.struct(*KEY)).over(order))
    # One row a range: its least key is what follows the range before it.
    firsts = ranged.groupBy("part").agg(F.min(F.struct(*KEY)).alias("least"))
    everything = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("least").over(everything), F.min("least").over(Window.partitionBy())).alias("least"))
    following_ = F.coalesce("next", "least")
    return common.cut(placed.join(after, "part").select(*KEY, "n_chars", following_["_k"].alias("_nk"), following_["_h"].alias("_nh")))


def edited_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp) of every row: see op7."""
    keyed = _keyed(docs, ident, text)
    after = following(keyed)
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    texts = keyed.dropDuplicates(KEY)  # equal rows are one within each task already
    wanted = after.select(F.col("_nk").alias("_k"), F.col("_nh").alias("_h"), F.col("_k").alias("_pk"), F.col("_h").alias("_ph"), quarter.alias("q"))
    heads = met(texts, wanted, KEY).select(F.col("_pk").alias("_k"), F.col("_ph").alias("_h"), F.col("q"), F.substring(F.col("text"), F.lit(1), F.col("q")).alias("head"))
    n = F.length("text")
    pair = met(texts, heads, KEY).select(*KEY, "text", F.concat(F.substring(F.col("text"), F.lit(1), n - F.col("q")), "head").alias("edited"))
    facts = pair.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    both = pair.select(*KEY, F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    prints = fingerprint_rows(both.select(*KEY, F.col("x.kind").alias("kind"), F.col("x.text").alias("text")), [*KEY, "kind"])
    prints = prints.groupBy(*KEY).agg(F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    rows = met(facts, prints, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("fp", "edited_fp")})
    rows = common.cut(rows)  # a few numbers a document; what follows reads them twice
    of_next = rows.select(F.col("_k").alias("_nk"), F.col("_h").alias("_nh"), F.col("fp").alias("next_fp"))
    out = met(met(rows, after, KEY), of_next, ["_nk", "_nh"]).select(*KEY, "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
    back = met(keyed.select(*KEY), out, KEY)  # every row again, equal ones too
    return back.select(F.when(F.col("_k") != _NULL_ID, F.col("_k")).alias("doc_id"), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def met(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the documents: never by sending one of them to all tasks, whatever its estimated size."""
    return a.join(b.hint("merge"), on, how)


def block_tables(radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """The blocks (first bit, bits) in the key of each table."""
    n = radius + PREFIX
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [[(edges[k], edges[k + 1] - edges[k]) for k in chosen] for chosen in combinations(range(n), PREFIX)]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query_fp, fp, distance): the distinct fingerprints (column fp) of prints within the radius of those of queries.

    One row a pair of distinct values; membership is by the value itself, so copies aren't
    multiplied. A hot key is a skewed side of an inner join, which adaptive execution splits.
    """
    tables = block_tables(radius)

    def key(fp: Column, blocks: list[tuple[int, int]]) -> Column:
        """The table's blocks side by side: the prefix of the permuted print."""
        out, at = F.lit(0).cast("long"), 0
        for first, bits in blocks:
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1)), at))
            at += bits
        return out

    def dealt(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("block"), key(F.col(name), blocks).alias("bits")) for t, blocks in enumerate(tables)])
        return df.select(name, F.explode(keys).alias("x")).select(name, "x.block", "x.bits")

    q = dealt(queries.select(F.col("fp").alias("query_fp")).distinct(), "query_fp")
    p = dealt(prints.select("fp").distinct(), "fp")
    pairs = met(p, q, ["block", "bits"])
    differ = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.lit(len(tables))
    for t, blocks in reversed(list(enumerate(tables))):
        mask = sum(((1 << bits) - 1) << at for at, bits in blocks)
        mask -= (1 << 64) if mask >> 63 else 0
        first = F.when(differ.bitwiseAND(F.lit(mask).cast("long")) == 0, t).otherwise(first)
    return pairs.filter((F.bit_count(differ) <= radius) & (F.col("block") == first)).select("query_fp", "fp", F.bit_count(differ).alias("distance"))


def with_near_prints(rows: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """rows (doc_id, fp, ...) with near_prints: for ids divisible by `every`, how many other fingerprints lie within the radius, else null."""
    of = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    asked = rows.filter(of)
    near = within_radius(asked.select("fp"), rows, radius).filter("distance > 0").groupBy(F.col("query_fp").alias("fp")).agg(F.count("*").alias("near_prints"))
    counted = met(asked, common.cut(near), ["fp"], "left").withColumn("near_prints", F.coalesce("near_prints", F.lit(0).cast("long")))
    return counted.unionByName(rows.filter(~of).withColumn("near_prints", F.lit(None).cast("long")))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_near_prints(common.cut(edited_fingerprints(common.table(spark, sf_dir, "documents"))))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "near_prints",
    )
