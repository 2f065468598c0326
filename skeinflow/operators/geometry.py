"""Layout geometry of recognised text: lines to message bubbles with a side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions.chinese_time import is_time_line
from skeinflow.operators import dedup

# Pixels and shares of the layout rules.
MERGE_DY, MERGE_DX = 62, 60
ALIGN = 30
LOW_CONFIDENCE, POOR_SHARE = 0.5, 0.6
BRIGHT_SUM, BRIGHT_LEAST = 450, 20

FRAME = "struct<left:double,top:double,width:double,height:double>"
LINES = f"array<struct<text:string,frame:{FRAME},confidence:double>>"
BLOCKS = f"array<struct<frame:{FRAME},lines:{LINES}>>"


def lines_of(images: DataFrame, key: str = "screenshot_id") -> DataFrame:
    """A row per line of ``blocks``: pos, text, confidence, x, y, width, height and whether it is placed (a
    finite frame with an area: the line's, else its block's)."""
    rows = images.select(key, F.posexplode("blocks").alias("b", "block")).select(key, "b", "block.frame", F.posexplode("block.lines").alias("l", "line"))
    good = lambda f: F.coalesce(~F.isnan(f["left"]) & ~F.isnan(f["top"]) & (F.abs(f["left"]) < 1e308) & (F.abs(f["top"]) < 1e308) & (f["width"] > 0) & (f["height"] > 0), F.lit(False))
    own, outer = F.col("line.frame"), F.col("frame")
    frame = F.when(good(own), own).when(good(outer), outer)
    order = Window.partitionBy(key).orderBy("b", "l")
    at = lambda f: F.coalesce(frame[f], F.lit(0.0)).alias({"left": "x", "top": "y"}.get(f, f))
    return rows.select(key, F.row_number().over(order).alias("pos"), F.col("line.text").alias("text"), F.col("line.confidence").alias("confidence"), at("left"), at("top"), at("width"), at("height"), frame.isNotNull().alias("placed"))


def poor_quality(lines: DataFrame, key: str = "screenshot_id") -> DataFrame:
    """key, share, poor: whether too many lines are uncertain; unknown confidence isn't low."""
    low = F.coalesce(F.col("confidence") < LOW_CONFIDENCE, F.lit(False))
    return dedup.share_over(lines, [key], low, POOR_SHARE, "poor")


def alignment_peaks(lines: DataFrame, width: float, key: str = "screenshot_id") -> DataFrame:
    """key, left_peak, right_peak: the commonest left edge in the left half and right edge in the right."""
    rows = lines.where("placed").withColumn("right", F.col("x") + F.col("width"))
    left = dedup.mode_peak(rows.where(F.col("x") < width / 2), [key], "x", "pos", "left_peak").drop("votes")
    right = dedup.mode_peak(rows.where(F.col("right") > width / 2), [key], "right", "pos", "right_peak").drop("votes")
    return left.join(right, key, "full_outer")


def bubbles(lines: DataFrame, key: str = "screenshot_id") -> DataFrame:
    """lines with ``bubble``: in (y, x) order a line joins the open bubble whose last line is nearest above
    (less than MERGE_DY below it and MERGE_DX aside; by y, then x, newest bubble first), else opens one.
    The choice among open bubbles is sequential: lines of one image go through one small function. Time
    lines belong to no bubble."""
    rows = lines.where(F.col("placed") & ~is_time_line(F.col("text")))

    def fold(image: pd.DataFrame) -> pd.DataFrame:
        image = image.sort_values(["y", "x", "pos"], kind="stable")
        open_: list[tuple[float, float]] = []  # (y, x) of each bubble's last line
        found = []
        for y, x in zip(image["y"], image["x"], strict=True):
            near = [(y - by, abs(x - bx), -i, i) for i, (by, bx) in enumerate(open_) if 0 <= y - by < MERGE_DY and abs(x - bx) < MERGE_DX]
            i = min(near)[3] if near else len(open_)
            open_[i : i + 1] = [(y, x)]
            found.append(i)
        return image.assign(bubble=found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", bubble int"
    return rows.groupBy(key).applyInPandas(fold, schema)


def bubble_sides(grouped: DataFrame, peaks: DataFrame, samples: DataFrame | None = None, key: str = "screenshot_id") -> DataFrame:
    """key, bubble, text, side: me if lines stand at the right peak only, them at the left only; if both,
    what the sample of the largest line says (samples: key, bubble, sample_side); else null."""
    rows = grouped.join(peaks, key, "left").withColumns({
        "_left": F.coalesce(F.abs(F.col("x") - F.col("left_peak")) <= ALIGN, F.lit(False)),
        "_right": F.coalesce(F.abs(F.col("x") + F.col("width") - F.col("right_peak")) <= ALIGN, F.lit(False)),
    })
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "pos", "text"))), lambda s: s["text"]), "\n")
    out = rows.groupBy(key, "bubble").agg(lines.alias("text"), F.bool_or("_left").alias("_left"), F.bool_or("_right").alias("_right"), F.max_by("pos", F.struct(F.col("width") * F.col("height"), -F.col("pos"))).alias("sample_line"))
    if samples is None:
        sampled = F.lit(None).cast("string")
    else:
        out, sampled = out.join(samples, [key, "bubble"], "left"), F.col("sample_side")
    side = F.when(F.col("_right") & ~F.col("_left"), "me").when(F.col("_left") & ~F.col("_right"), "them").when(F.col("_left") & F.col("_right"), sampled)
    return out.select(key, "bubble", "text", side.alias("side"), "sample_line")


def sampled_colors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, g, b, side of regions: exact medians of the bright pixels if there are enough, else of
    all; green is me, near white is them."""
    bright = F.col("r") + F.col("g") + F.col("b") > BRIGHT_SUM
    enough = F.count_if(bright) >= BRIGHT_LEAST
    median = lambda c: F.when(enough, F.median(F.when(bright, F.col(c)))).otherwise(F.median(c)).alias(c)
    out = pixels.groupBy(*keys).agg(*[median(c) for c in "rgb"])
    white = (F.col("r") > 245) & (F.col("g") > 245) & (F.col("b") > 245)
    return out.withColumn("side", F.when(F.col("g") - F.col("b") > 40, "me").when(white, "them"))


def pixel_rectangle(df: DataFrame, image_width: str, image_height: str) -> DataFrame:
    """Whole-pixel rectangle of a frame, inside the image and at least one pixel wide and high."""
    left = F.greatest(F.lit(0), F.floor("x")).cast("long")
    top = F.greatest(F.lit(0), F.floor("y")).cast("long")
    right = F.least(F.col(image_width).cast("long"), F.ceil(F.col("x") + F.col("width")).cast("long"))
    bottom = F.least(F.col(image_height).cast("long"), F.ceil(F.col("y") + F.col("height")).cast("long"))
    return df.withColumns({"px": left, "py": top, "pw": F.greatest(F.lit(1).cast("long"), right - left), "ph": F.greatest(F.lit(1).cast("long"), bottom - top)})
