"""Page geometry: effective boxes, fit decisions, placements and what a transform drops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def effective_geometry(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Displayed size of every page: (accepted, rejected).

    Boxes are corner-normalised, intersected, scaled by the user unit; an odd quarter turn
    swaps the sides.  An empty, infinite or NaN result is rejected, as is a box without exactly
    four numbers.  ``crop`` may be null; an absent rotation is 0, an absent user unit 1.
    """
    pages = pages.withColumns({"rotate": F.coalesce("rotate", F.lit(0)), "unit": F.coalesce("unit", F.lit(1))})
    low = lambda box, i: F.least(F.get(box, i), F.get(box, i + 2))
    high = lambda box, i: F.greatest(F.get(box, i), F.get(box, i + 2))
    # greatest/least skip nulls, so an absent crop box leaves the media box as it is.
    boxed = pages.withColumns({
        "box_x0": F.greatest(low("media", 0), low("crop", 0)),
        "box_y0": F.greatest(low("media", 1), low("crop", 1)),
        "box_x1": F.least(high("media", 0), high("crop", 0)),
        "box_y1": F.least(high("media", 1), high("crop", 1)),
    })
    turned = F.col("rotate") % 180 != 0
    across = (F.col("box_x1") - F.col("box_x0")) * F.col("unit")
    along = (F.col("box_y1") - F.col("box_y0")) * F.col("unit")
    shown = boxed.withColumns({
        "width": F.when(turned, along).otherwise(across),
        "height": F.when(turned, across).otherwise(along),
    })
    whole = lambda box: (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    usable = lambda c: (c > 0) & ~F.isnan(c) & (c != float("inf"))
    good = F.coalesce(
        usable(F.col("width")) & usable(F.col("height")) & whole("media") & (F.col("crop").isNull() | whole("crop")) & (F.col("rotate") % 90 == 0), F.lit(False)
    )
    return shown.filter(good), shown.filter(~good)


def fit_decisions(pages: DataFrame, target_w: Column, target_h: Column, tolerance: Column) -> DataFrame:
    """Keep a page when both ordered sides lie within the tolerance of the target, else fit it.

    The interval ends are rounded once each; a null target means no policy: keep.
    """
    near = lambda side, goal: (side >= goal - tolerance) & (side <= goal + tolerance)
    keeps = target_w.isNull() | (near(F.col("width"), target_w) & near(F.col("height"), target_h))
    return pages.withColumns({
        "transform": ~keeps,
        "output_w": F.when(keeps, F.col("width")).otherwise(target_w),
        "output_h": F.when(keeps, F.col("height")).otherwise(target_h),
    })


def fit_placements(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scale and affine coefficients of every transformed page: (placed, rejected).

    The page is turned upright, scaled by the smaller side ratio and centred on the sheet.
    Expects the columns of ``effective_geometry`` and ``fit_decisions``.
    """
    turn = F.expr("((rotate % 360) + 360) % 360")
    pick = lambda zero, quarter, half, three: (
        F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(zero)
    )
    x0, y0, x1, y1 = (F.col(c) for c in ("box_x0", "box_y0", "box_x1", "box_y1"))
    upright_w = pick(x1 - x0, y1 - y0, x1 - x0, y1 - y0)
    upright_h = pick(y1 - y0, x1 - x0, y1 - y0, x1 - x0)
    left = pick(x0, y0, -x1, -y1)
    bottom = pick(y0, -x1, -y1, x0)
    moved = pages.filter("transform").withColumns({
        "scale": F.least(F.col("output_w") / upright_w, F.col("output_h") / upright_h),
    })
    scale = F.col("scale")
    zero = F.lit(0.0)
    placed = moved.withColumns({
        "a": pick(scale, zero, -scale, zero), "b": pick(zero, -scale, zero, scale),
        "c": pick(zero, scale, zero, -scale), "d": pick(scale, zero, -scale, zero),
        "e": (F.col("output_w") - scale * upright_w) / 2 - scale * left,
        "f": (F.col("output_h") - scale * upright_h) / 2 - scale * bottom,
    })
    finite = lambda c: ~F.isnan(c) & (F.abs(c) != float("inf"))
    good = F.coalesce((scale > 0) & finite(scale) & finite(F.col("e")) & finite(F.col("f")), F.lit(False))
    return placed.filter(good), placed.filter(~good)


def dropped_boxes(pages: DataFrame) -> DataFrame:
    """One warning for every printing box that a transform drops."""
    boxes = F.array(*[
        F.when(F.col(name).isNotNull(), F.lit(name)) for name in ("bleed", "trim", "art")
    ])
    return (
        pages.filter("transform")
        .select("page", F.explode(boxes).alias("box"))
        .filter(F.col("box").isNotNull())
        .withColumn("code", F.lit("fit_print_box_omitted"))
    )


def moved_targets(targets: DataFrame, fitted: DataFrame) -> DataFrame:
    """Links and names with numeric coordinates that point at a transformed page."""
    moved = fitted.filter("transform").select(F.col("page").alias("target_page"))
    return targets.filter("has_coordinates").join(moved, "target_page", "left_semi").withColumn(
        "code", F.lit("fit_destination_unsupported")
    )
