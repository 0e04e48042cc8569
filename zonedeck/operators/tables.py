"""Table lookups, sorting, file verbs and control breaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def search(table: Column, when: Callable[[Column], Column], start: Column | int = 1) -> Column:
    """SEARCH: the first element from index `start` on for which `when` holds; null at the end."""
    start = F.lit(start) if isinstance(start, int) else start
    return F.get(F.filter(F.slice(table, start, F.greatest(F.size(table) - start + 1, F.lit(0))), when), F.lit(0))


def search_all(table: Column, key: str, value: Column, descending: bool = False) -> Column:
    """SEARCH ALL: binary search on the key; index from 1, null if it isn't met. Unsorted tables may miss, as binary search does."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(table) + 1)).cast("int"), F.lit(0)))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        at = F.get(table, middle - 1)[key]
        before = at > value if descending else at < value
        open_ = (state["found"] == 0) & (state["low"] <= state["high"])
        return F.struct(
            F.when(open_ & before, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(open_ & (at != value) & ~before, middle - 1).otherwise(state["high"]).alias("high"),
            F.when(open_ & (at == value), middle).otherwise(state["found"]).alias("found"),
        )

    first = F.struct(F.lit(1).alias("low"), F.size(table).alias("high"), F.lit(0).alias("found"))
    return F.aggregate(steps, first, halve, lambda s: F.when(s["found"] > 0, s["found"]))


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SEARCH ALL over a loaded file: a left join on the key; the size of the table decides how."""
    return rows.join(table, list(keys), "left")


def sort_records(rows: DataFrame, *keys: Column, order: str = "record_index") -> DataFrame:
    """SORT: by the keys, stable by the place in the input."""
    return rows.orderBy(*keys, order)


def display_key(text: Column) -> Column:
    """Numeric DISPLAY sort key: blank is 0, a trailing sign raises."""
    plain = F.trim(text)
    return F.when(plain == "", F.lit(0)).when(plain.rlike(r"[+-]$"), F.raise_error(F.lit("CBL-RT-DECIMAL: trailing sign in a sort key"))).otherwise(plain.cast("decimal(18,0)"))


def merge_records(*inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE as an extension: all inputs by the keys."""
    out = inputs[0]
    for other in inputs[1:]:
        out = out.unionByName(other)
    return out.orderBy(*keys)


def rewrite(rows: DataFrame, condition: Column, **columns: Column) -> DataFrame:
    """REWRITE: new values where the condition holds."""
    return rows.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in columns.items()})


def delete(rows: DataFrame, condition: Column) -> DataFrame:
    """DELETE: rows for which the condition holds go; unknown ones stay."""
    return rows.filter(~F.coalesce(condition, F.lit(False)))


def control_break(rows: DataFrame, key: Sequence[str], **totals: Column) -> DataFrame:
    """Totals of a READ loop with a control break: one row a key."""
    return rows.groupBy(*key).agg(*[v.alias(k) for k, v in totals.items()])


def advance(rows: DataFrame, lines: Column, linage: int, order: str = "record_index", by: Sequence[str] = ("src_file",)) -> DataFrame:
    """WRITE AFTER ADVANCING with LINAGE: rows with the page and line of each record, a page break where the line would pass the page.

    Pages follow from all lines before within a file, so a file's records pass through one task in
    order, of which only the last page and line are kept.
    """
    names, shown = [*by, order], [*rows.columns, "page", "line"]
    counted = rows.withColumn("_lines", lines.cast("int"))
    at = {c: counted.columns.index(c) for c in (*names, "_lines")}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, page, line = None, 1, 0
        for batch in batches:
            pages, places = [], []
            for *now, _, n in zip(*(batch.column(at[c]).to_pylist() for c in (*names, "_lines"))):
                if now != file:
                    file, page, line = now, 1, 0
                if line + (n or 0) > linage:
                    page, line = page + 1, 1
                else:
                    line += n or 0
                pages.append(page)
                places.append(line)
            columns = [c for k, c in enumerate(batch.columns) if k != at["_lines"]]
            yield pa.record_batch([*columns, pa.array(pages, pa.int32()), pa.array(places, pa.int32())], names=shown)

    ordered = (counted.repartition(*by) if by else counted.repartition(1)).sortWithinPartitions(*names)
    return ordered.mapInArrow(fold, T.StructType([*rows.schema, T.StructField("page", T.IntegerType()), T.StructField("line", T.IntegerType())]))


def record_numbers(rows: DataFrame, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """record_index from 0 in the order given, within `by`."""
    return rows.withColumn("record_index", (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))


def coverage_runs(ranges: DataFrame, record_length: int) -> DataFrame:
    """(kind, start, end): bytes that no range covers and that several do, as runs."""
    every = ranges.sparkSession.range(record_length).select(F.col("id").alias("b"))
    used = ranges.select(F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("b"))
    counted = every.join(used.groupBy("b").agg(F.count("*").alias("n")), "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n"))
    marked = counted.select("b", F.when(F.col("n") == 0, "gap").when(F.col("n") > 1, "overlap").alias("kind")).filter("kind IS NOT NULL")
    island = F.col("b") - F.row_number().over(Window.partitionBy("kind").orderBy("b"))
    return marked.withColumn("i", island).groupBy("kind", "i").agg(F.min("b").alias("start"), (F.max("b") + 1).alias("end")).select("kind", "start", "end")
