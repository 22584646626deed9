"""Conversions of unit spellings, learned from quantities that say the same thing twice.

Spellings are the nodes of a graph.  Two values of one and the same measured thing link two spellings:
a dual statement (a quantity and the one it restates), and a value with what an earlier run made of it.
The links of two spellings are estimated together and robustly: the median of the ratios and, where the
ratios scatter, the median of slopes between links taken two by two and the median of what then remains
as offset; so a minority of wrong links changes nothing.  From the canonical units, whose conversion is
known, and then from spellings of the table that these do not reach, estimates are carried along the graph.  Each is snapped to the exact conversion of its parameter
that lies within ``TOLERANCE``; one that fits none is dropped, so rounded prints never blur a result, and
errors do not add up along a path.

The table of spellings supplies the exact conversions to snap to.  Beyond that it decides only for
spellings that fewer than ``DECIDES`` links reach; with as many, the links decide.

Defined cases: an empty table of links gives the table of spellings; values of zero and prints of too few
digits to tell two conversions apart (``PRECISION``) are no links; a spelling linked to units of two
parameters takes the one with more links.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.unit_names import CANONICAL, spellings
from tessera.plans.workspace import Workspace

#: Relative error of a printed number up to which it links; distance to an exact conversion; scatter of ratios.
PRECISION, TOLERANCE, SCATTER = 0.006, 0.006, 0.02
#: Scatter from which on an offset is looked for too.
STRAIGHT = 0.004
#: Distance of a slope to that of an exact conversion, which it is further from than the values in the middle are.
SLOPE = 0.03
#: Links needed to give a spelling of no table a conversion, and to overrule the table.
LEAST, DECIDES = 3, 15
#: Links met on one slope, on average.
PER_SLOPE = 4
ROUNDS = 6


def known(spark: SparkSession, canonical: DataFrame) -> DataFrame:
    """Spellings of the table with their exact conversions, for the wanted parameters."""
    rows = [(form, parameter, CANONICAL[parameter], scale, offset) for form, (parameter, scale, offset) in spellings().items()]
    table = spark.createDataFrame(rows, "form string, measures string, unit string, scale double, offset double")
    wanted = canonical.select(F.col("parameter").alias("measures"), F.col("canonical_unit").alias("unit")).distinct()
    return table.join(wanted, ["measures", "unit"]).select("form", "measures", F.col("unit").alias("canonical_unit"), "scale", "offset")


def precision(number: Column) -> Column:
    """Half a unit of the last printed place, relative to the number."""
    text = F.format_string("%.6f", number)
    places = F.length(F.regexp_replace(F.regexp_extract(text, "\\.(\\d*)$", 1), "0+$", ""))
    return F.try_divide(0.5 * F.pow(F.lit(10.0), -places), F.abs(number))


def estimates(links: DataFrame) -> DataFrame:
    """links (u, x, v, y): the same thing is x in u and y in v.  One row per two spellings, both ways:
    y = slope * x + offset, and how many links say so."""
    exact = links.where((F.col("u") != F.col("v")) & (F.col("x") != 0) & (F.col("y") != 0) & (precision(F.col("x")) <= PRECISION) & (precision(F.col("y")) <= PRECISION))
    both = exact.select(F.explode(F.array(F.struct("u", "x", "v", "y"), F.struct(F.col("v").alias("u"), F.col("y").alias("x"), F.col("u").alias("v"), F.col("x").alias("y")))).alias("l")).select("l.*")
    middle = lambda c: F.percentile_approx(c, 0.5, 10_000)
    ratio = both.groupBy("u", "v").agg(F.count(F.lit(1)).alias("links"), middle(F.col("y") / F.col("x")).alias("ratio"), middle(F.col("x")).alias("mid"))
    with_ratio = both.join(ratio.where(F.col("links") >= LEAST), ["u", "v"])
    spread = with_ratio.groupBy("u", "v").agg(F.first("links").alias("links"), F.first("ratio").alias("ratio"), F.first("mid").alias("mid"),
                                              middle(F.abs(F.col("y") / (F.col("x") * F.col("ratio")) - 1)).alias("scatter"))
    straight = spread.where(F.col("scatter") <= SCATTER).select("u", "v", "links", F.col("ratio").alias("slope"), F.lit(0.0).alias("offset"), "mid")
    bent = with_ratio.join(spread.where(F.col("scatter") > STRAIGHT).select("u", "v"), ["u", "v"], "left_semi")
    place = F.xxhash64("x", "y", "u", "v")
    cell = F.pmod(place, F.greatest(F.lit(1), F.ceil(F.col("links") / PER_SLOPE)).cast("long"))
    ends = bent.groupBy("u", "v", cell.alias("cell")).agg(F.min_by(F.struct("x", "y"), place).alias("a"), F.max_by(F.struct("x", "y"), place).alias("b"))
    slope = ends.where(F.col("a.x") != F.col("b.x")).groupBy("u", "v").agg(middle((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))).alias("slope"))
    offset = bent.join(slope, ["u", "v"]).groupBy("u", "v").agg(F.first("links").alias("links"), F.first("slope").alias("slope"),
                                                                middle(F.col("y") - F.col("slope") * F.col("x")).alias("offset"), F.first("mid").alias("mid"))
    return straight.unionByName(offset)


def _snapped(reached: DataFrame, exact: DataFrame) -> DataFrame:
    """reached (form, measures, scale, offset, mid, links) to the nearest exact conversion of the parameter:
    close in scale, and within the tolerance at the middle of the values that were linked."""
    off = F.abs((F.col("scale") - F.col("s")) * F.col("mid") + F.col("offset") - F.col("o"))
    near = reached.join(exact.withColumnRenamed("scale", "s").withColumnRenamed("offset", "o"), "measures").where(
        (F.abs(F.log(F.try_divide(F.col("scale"), F.col("s")))) <= SLOPE) & (off <= TOLERANCE * F.abs(F.col("s") * F.col("mid"))))
    miss = off / F.abs(F.col("s") * F.col("mid")) + F.abs(F.log(F.col("scale") / F.col("s")))
    # The better supported path first, then the nearer conversion.
    return near.groupBy("form").agg(F.max_by(F.struct("measures", F.col("s").alias("scale"), F.col("o").alias("offset"), "links"), F.struct("links", -miss)).alias("c")).select("form", "c.*")


def conversions(links: DataFrame, canonical: DataFrame, anchors: DataFrame, ws: Workspace) -> DataFrame:
    """(form, measures, canonical_unit, scale, offset, links) of every spelling that is known or reached.

    ``anchors`` (form, measures) are the canonical units' own spellings."""
    table = ws.save(known(links.sparkSession, canonical), "known")
    edges = ws.save(estimates(links), "edges")
    exact = F.broadcast(table.select("measures", "scale", "offset").distinct())
    solved = anchors.select("form", "measures", F.lit(1.0).alias("scale"), F.lit(0.0).alias("offset"), F.lit(1 << 40).cast("long").alias("links"))
    every = [solved]

    def carry(frontier: DataFrame, label: str) -> None:
        """Carries conversions from the frontier on until no new spelling is reached."""
        for step in range(ROUNDS):
            done = reduce(DataFrame.unionByName, every)
            from_there = edges.join(frontier.select(F.col("form").alias("v"), "measures", F.col("scale").alias("sv"), F.col("offset").alias("ov"), F.col("links").alias("lv")), "v")
            reached = from_there.select(F.col("u").alias("form"), "measures", (F.col("sv") * F.col("slope")).alias("scale"),
                                        (F.col("sv") * F.col("offset") + F.col("ov")).alias("offset"), "mid", F.least("links", "lv").alias("links"))
            frontier = ws.save(_snapped(reached.join(done.select("form"), "form", "left_anti"), exact), f"{label}{step}")
            if frontier.isEmpty():
                break
            every.append(frontier)

    carry(solved, "reached")
    # What the canonical units' own spellings don't reach may be tied to other known spellings.
    rest = table.join(reduce(DataFrame.unionByName, every).select("form"), "form", "left_anti").select(
        "form", "measures", "scale", "offset", F.lit(1 << 40).cast("long").alias("links"))
    rest = ws.save(rest, "rest")
    every.append(rest)
    carry(rest, "further")
    linked = reduce(DataFrame.unionByName, [x for x in every if x is not rest])
    units = canonical.select(F.col("parameter").alias("measures"), "canonical_unit").distinct()
    named = linked.join(F.broadcast(units), "measures")
    both = table.select("form", F.struct("measures", "canonical_unit", "scale", "offset").alias("t")).join(
        named.select("form", F.struct("measures", "canonical_unit", "scale", "offset").alias("g"), "links"), "form", "full_outer")
    c = F.when(F.col("t").isNull() | (F.col("links") >= DECIDES), F.coalesce("g", "t")).otherwise(F.col("t"))
    return both.select("form", c.alias("c"), F.coalesce("links", F.lit(0)).alias("links"), F.col("t").isNotNull().alias("spelled")).select("form", "c.*", "links", "spelled")
