"""Lines of a page in reading order: margin labels go before the paragraph they stand beside, stray hyphens to their line.

Lines are line_boxes(path, page, line_no, left, top, page_width, text) with the origin at the bottom left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factgrid.functions.text import BREAK_MARK, join_hyphens, strip
from factgrid.operators import segmented
from factgrid.operators.intervals import blocks

# fixed values: the page format's distances in points, the margin's share of the width, the longest label
LABEL_SHARE = 0.27
LABEL_CHARS = 60
BLOCK_GAP = 16.0
ANCHOR = 14.0
HYPHEN_REACH = 6.0
# fixed value: marks that end a line of running text
END_MARKS = r"[.,;:]$"
SOFT_HYPHEN = "\u00ad"
_PAGE = ("path", "page")


def split_labels(lines: DataFrame) -> DataFrame:
    """lines with `is_label`: short lines in the left margin that don't end a sentence."""
    label = (F.col("left") < F.col("page_width") * LABEL_SHARE) & (F.length(strip(F.col("text"))) < LABEL_CHARS) & ~strip(F.col("text")).rlike(END_MARKS)
    return lines.withColumn("is_label", label)


def place_hyphens(lines: DataFrame) -> DataFrame:
    """Lines of a hyphen alone become a soft hyphen behind the line left of them at about their height: the rightmost, main lines first; others stay out."""
    alone = strip(F.col("text")).isin("-", SOFT_HYPHEN, "\x02")
    stray = lines.where(alone).select(*_PAGE, F.col("line_no").alias("h"), F.col("left").alias("h_left"), F.col("top").alias("h_top"))
    rest = lines.where(~alone).withColumn("text", strip(F.col("text")))
    # a line reaches the cells of height around it, so that the join is on equal cells
    cell = lambda c: F.floor(F.col(c) / HYPHEN_REACH)
    near = rest.select(*_PAGE, "line_no", "left", "top", "is_label", F.explode(F.sequence(cell("top") - 1, cell("top") + 1)).alias("cell"))
    met = stray.withColumn("cell", cell("h_top")).join(near, [*_PAGE, "cell"]).where((F.abs(F.col("top") - F.col("h_top")) <= HYPHEN_REACH) & (F.col("left") < F.col("h_left")))
    to = met.withColumn("n", F.row_number().over(Window.partitionBy(*_PAGE, "h").orderBy(F.desc("left"), "is_label", "line_no"))).where("n = 1")
    marks = to.groupBy(*_PAGE, "line_no").agg(F.repeat(F.lit(SOFT_HYPHEN), F.count("*").cast("int")).alias("marks"))
    return rest.join(marks, [*_PAGE, "line_no"], "left").withColumn("text", F.concat("text", F.coalesce("marks", F.lit("")))).drop("marks")


def label_anchors(lines: DataFrame) -> DataFrame:
    """(path, page, block, label, at): label blocks and the place of the first main line not above them by more than ANCHOR.

    at is the line's place in reading order (from 1), null where all main lines are above; two running values, no range join.
    """
    key = F.struct(*_PAGE)
    marked = blocks(lines.where("is_label").withColumn("_p", key), "_p", "top", BLOCK_GAP)
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("top")).alias("d"), "line_no", "text"))), lambda x: x["text"]), " ")
    label = marked.groupBy(*_PAGE, "block").agg(F.max("top").alias("y"), F.regexp_replace(words, BREAK_MARK + "\\s*", "").alias("label"))
    reading = [-F.bround("y"), F.col("left"), F.col("line_no")]
    mains = lines.where("not is_label").select(*_PAGE, F.col("top").cast("double").alias("y"), "left", "line_no")
    mains = segmented.scanned(segmented.dealt(mains, reading, _PAGE), reading, {"earlier": segmented.running_count()}, _PAGE).select(*_PAGE, "y", (F.col("earlier") + 1).alias("pos"))
    both = mains.withColumn("block", F.lit(None).cast("long")).withColumn("label", F.lit(None).cast("string")).unionByName(label.select(*_PAGE, (F.col("y") + ANCHOR).alias("y"), F.col("block").cast("long"), "label"), allowMissingColumns=True)
    upwards = [F.col("y"), F.col("block")]  # main lines, which have no block, before a label at their height
    both = segmented.scanned(segmented.dealt(both, upwards, _PAGE), upwards, {"at": segmented.running_min(F.col("pos"))}, _PAGE)
    return both.where("block is not null").select(*_PAGE, "block", "label", "at")


def page_texts(lines: DataFrame) -> DataFrame:
    """(path, page, text): a page's lines in reading order, each label block behind a blank line before its paragraph, those without one at the end; broken words are joined."""
    ready = place_hyphens(split_labels(lines))
    order = Window.partitionBy(*_PAGE).orderBy(-F.bround("top"), "left", "line_no")
    mains = ready.where("not is_label").select(*_PAGE, F.row_number().over(order).alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), "text")
    labels = label_anchors(ready).select(*_PAGE, F.coalesce("at", F.lit(2**31 - 1)).alias("at"), F.lit(0).alias("kind"), F.col("block").cast("long").alias("block"), F.concat(F.lit("\n"), "label").alias("text"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("at", "kind", "block", "text"))), lambda x: x["text"])
    return mains.unionByName(labels).groupBy(*_PAGE).agg(join_hyphens(F.array_join(joined, "\n")).alias("text"))
