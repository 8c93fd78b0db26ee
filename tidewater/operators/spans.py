"""Which span encloses a site most closely, without testing all spans of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.session import Scratch

#: Offsets are below 2 to this power.
LEVELS = 40
#: Sites of one cell that are one block; cells with more are dealt out in blocks of about so many.
BLOCK = 100_000


def _cells(start: Column, end: Column) -> Column:
    """(level, cell) of the largest aligned cells of 1, 2, 4, ... offsets that make up a span: two a level at most."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    low = lambda k: F.ceil(start / power(k)).cast("long")
    high = lambda k: F.floor((end + 1) / power(k)).cast("long")
    at = lambda k, cell: F.struct(k.alias("level"), cell.alias("cell"))

    def of_level(k: Column) -> Column:
        # the first cell if its half lies outside the next larger, then the last one likewise
        lone = (low(k) < high(k)) & (low(k) % 2 == 1)
        rest = low(k) + low(k) % 2
        return F.array_compact(F.array(F.when(lone, at(k, low(k))), F.when((rest < high(k)) & (high(k) % 2 == 1), at(k, high(k) - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def owners(sites: DataFrame, spans: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """sites(id, file, start, end), spans(span_id, file, start, end, kind_rank, name) -> (id, span_id, enclosing, status).

    The owner of a site is the smallest span of its file that holds it, both ends included; of
    equals the one with the least kind_rank, start, end and name. status is owned, ambiguous
    if several spans are equal in all of these (span_id is null), and none. `enclosing` counts
    the spans that hold the site. Ids are unique; sites and spans with a null file or end are
    in no file, and spans that end before they start hold nothing. Offsets are whole numbers
    from 0, below 2 ** LEVELS.

    A span is the union of a few aligned cells, and a site's start lies in one cell of each
    size, so both meet by equality. Of a cell's spans a site needs no more than how many end
    with it or later and which of those is best: running counts and minima over the cell's ends
    in falling order, so sites and spans are never paired. Equal sites are one until the end.
    Cells with very many sites are dealt out in blocks.
    """
    whole = "file is not null and start >= 0 and end >= start"
    order = ["size", "kind_rank", "s", "e", "name"]
    held = spans.where(whole).select("file", "span_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), "kind_rank", "name").withColumn("size", F.col("e") - F.col("s"))
    alike = held.groupBy("file", *order).agg(F.count("*").alias("n"), F.min("span_id").alias("span_id"))
    cells = alike.select("file", F.explode(_cells(F.col("s"), F.col("e"))).alias("c"), "e", "n", F.struct(*order, "n", "span_id").alias("b"))
    ends = cells.groupBy("file", "c.level", "c.cell", "e").agg(F.sum("n").alias("n"), F.min("b").alias("b"))
    ends = scratch.keep(ends, "cells")
    levels = [r["level"] for r in ends.select("level").distinct().collect()]  # LEVELS + 1 numbers at most
    place = ["file", "start", "end"]
    plain = sites.where("file is not null and start >= 0 and end is not null").select("file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).distinct()
    steps = F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("start", k).alias("cell")) for k in sorted(levels))) if levels else F.array().cast("array<struct<level:int,cell:bigint>>")
    asked = plain.select("*", F.explode(steps).alias("c")).select(*place, "c.level", "c.cell")
    key = ["file", "level", "cell"]
    # only cells of spans are looked for
    asked = asked.join(ends.select(*key).distinct(), key, "left_semi")
    large = asked.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    large = scratch.keep(large, "large")
    blocks = F.coalesce("blocks", F.lit(1))
    left = asked.join(large, key, "left").withColumn("part", F.pmod(F.xxhash64("start", "end"), blocks).cast("int"))
    right = ends.join(large, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), blocks - 1)))
    none = lambda c: F.lit(None).cast(ends.schema[c].dataType).alias(c)
    # spans that end where a site does hold it, so they come first
    both = right.select(*key, "part", F.col("e").alias("at"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("start"), "n", "b")
    both = both.union(left.select(*key, "part", F.col("end").alias("at"), F.lit(1).alias("asks"), "start", none("n"), none("b")))
    so_far = Window.partitionBy(*key, "part").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("n", F.sum("n").over(so_far)).withColumn("b", F.min("b").over(so_far)).where("asks = 1 and b is not null")
    of_place = met.groupBy("file", "start", F.col("at").alias("end")).agg(F.sum("n").alias("enclosing"), F.min("b").alias("b"))
    asking = sites.select("id", "file", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    # an id that several sites have is held by the spans of each
    tied = asking.join(of_place, place).select("id", "enclosing", "b.*").groupBy("id", *order).agg(F.sum("enclosing").alias("enclosing"), F.sum("n").alias("n"), F.min("span_id").alias("span_id"))
    best = tied.groupBy("id").agg(F.sum("enclosing").alias("enclosing"), F.min(F.struct(*order, "n", "span_id")).alias("b"))
    found = sites.select("id").join(best, "id", "left")
    status = F.when(F.col("b").isNull(), "none").when(F.col("b.n") > 1, "ambiguous").otherwise("owned")
    return found.select("id", F.when(status == "owned", F.col("b.span_id")).alias("span_id"), F.coalesce("enclosing", F.lit(0)).alias("enclosing"), status.alias("status"))
