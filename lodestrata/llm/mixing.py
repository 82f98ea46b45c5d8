"""Mixing sources to target weights by a curriculum that varies over training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

#: The weights that sources take in turn.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix takes, and how often a source may be read.
SHARE, REPEATS = 1.5, 2
#: A source's weight over training runs linearly from 1 + tilt to 1 - tilt times its mean; sources
#: take these tilts in turn, so some come early and some late.
TILTS = (0.5, 0.0, -0.5)
#: Hexadecimal digits of the order hash that make a cell: the sums of a source's 4,096 cells give each
#: its place, so that no task adds up a whole source.
CELL_DIGITS = 3


def source_targets(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """Each source's size and target, from rows with a `size`. Targets are weight x level, but at most
    REPEATS x the source's size, at the one level where they add up to SHARE x all sizes: what
    resharing the excess by weight arrives at. Found by one ordered pass over the sources."""
    sums = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1).alias("turn")
    named = sums.select("source", "source_size", turn)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("turn") % len(values) + 1).cast("int"))
    cap = F.col("source_size") * float(REPEATS)
    full = Window.orderBy(cap / F.col("weight"), "turn")
    upto, rest = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighed = named.withColumn("weight", pick(WEIGHTS)).withColumn("tilt", pick(TILTS))
    everything = Window.partitionBy()
    levels = weighed.withColumn("level", (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum(cap).over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    # The level holds at the first source, in order of cap / weight, that stays below its cap.
    met = F.min(F.when(F.col("level") <= cap / F.col("weight"), F.struct(cap / F.col("weight"), F.col("turn"), F.col("level").alias("level")))).over(everything)
    target = F.least(cap, F.coalesce(met["level"] * F.col("weight"), cap))
    return levels.select("source", "source_size", target.alias("target"), "tilt")


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of docs: row (all its columns, a struct), id, source, size (words), its source's
    source_size, target and tilt, middle (the middle of the row's words in its source's demand), and
    copies (0, 1 or 2).

    Rows of a source stand in the order of md5 of id and text. The words they demand add up along it,
    one pass after another, until the target; a copy is taken if its middle lies before that, so a
    source's taken words end within half a document of its target. The running sums are exact: those
    of the cells (prefixes of the md5) before, and those of the rows before in the cell. Only what is
    used moves: without `row` these are a few numbers for each row.

    Null texts have size 0 and are taken 0 times, null sources are a source of their own (the last),
    null ids count as an empty id. Repeated rows each count; those equal in id and text stand in a
    row, and all rows of such a kind meet in one cell.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))).cast("binary"))
    # A source's key without nulls, so that rows and sums meet by plain equality after one exchange.
    known, name = F.col(source_col).isNotNull(), F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    sized = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), known.alias("known"), name.alias("name"), size.alias("size"), order.alias("order"), F.substring(order, 1, CELL_DIGITS).alias("cell"))
    cells = written(sized.groupBy("source", "known", "name", "cell").agg(F.sum("size").alias("size")))
    targets = source_targets(cells).select(F.col("source").isNotNull().alias("known"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"), "source_size", "target", "tilt")
    key = ["known", "name", "cell"]
    before = Window.partitionBy("known", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*key, F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    goals = offsets.join(targets, ["known", "name"])
    inside = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = sized.withColumn("inside", inside).join(goals, key).withColumn("middle", (F.col("offset") + F.col("inside")).cast("double") + F.col("size").cast("double") / 2)
    passes = F.floor((F.col("target") - F.col("middle")) / F.col("source_size")) + 1
    copies = F.when(F.col("size") > 0, F.least(F.greatest(passes, F.lit(0)), F.lit(REPEATS))).otherwise(0)
    return joined.select("row", "id", "source", "size", "source_size", "target", "tilt", "middle", copies.cast("int").alias("copies"))


def positions(placed: DataFrame) -> DataFrame:
    """placed with `positions`: for each taken copy the moment of training, in [0, 1], at which its
    source's integrated weight schedule reaches the copy's share of the target. With the weight
    1 + a (1 - 2t) the integral is t + a t (1 - t); its inverse is a root in closed form."""
    a, b = F.col("tilt"), F.col("tilt") + 1

    def place(copy):
        share = F.least(F.lit(1.0), (F.col("middle") + copy * F.col("source_size")) / F.col("target"))
        root = (b - F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * a * share))) / (2 * a)
        return F.when(a == 0, share).otherwise(root)

    return placed.withColumn("positions", F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0))), place)).otherwise(F.array().cast("array<double>")))


def ordered(copies: DataFrame, partitions: int | None = None) -> DataFrame:
    """The training order of copies (id, position): range-sorted by position, ties by id."""
    spread = copies.repartitionByRange(partitions, "position", "id") if partitions else copies.repartitionByRange("position", "id")
    return spread.sortWithinPartitions("position", "id")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The training order: the rows of docs, repeated as the mix takes them, range-sorted by position.
    Returns the columns of docs, sorted; empty texts take no part as they have no words."""
    placed = positions(curriculum(docs, id_col, text_col, source_col))
    return ordered(placed.select("row", "id", F.explode("positions").alias("position")), partitions).select("row.*")
