"""Boxes on pages: matching, nesting, separators and the text read in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import boxes
from quillmark.session import scratch

SIDES = ["x1", "y1", "x2", "y2"]


def candidates(found: DataFrame, answers: DataFrame, least_iou: float = 0.3) -> DataFrame:
    """page, det, ans and iou of the pairs on a page that overlap enough, or whose centre lies inside and whose area is a quarter."""
    d, a = [F.col(f"d_{s}") for s in SIDES], [F.col(f"a_{s}") for s in SIDES]
    left = found.select("page", "det", *[F.col(s).alias(f"d_{s}") for s in SIDES], boxes.area(*map(F.col, SIDES)).alias("d_area"))
    right = answers.select("page", "ans", *[F.col(s).alias(f"a_{s}") for s in SIDES], boxes.area(*map(F.col, SIDES)).alias("a_area"))
    # whatever overlaps or has its centre inside touches on both axes
    touching = (d[0] <= a[2]) & (a[0] <= d[2]) & (d[1] <= a[3]) & (a[1] <= d[3])
    cx, cy = (d[0] + d[2]) / 2, (d[1] + d[3]) / 2
    inside = (cx >= a[0]) & (cx <= a[2]) & (cy >= a[1]) & (cy <= a[3]) & (F.col("d_area") >= 0.25 * F.col("a_area"))
    shared = boxes.overlap(d, a)
    both = F.col("d_area") + F.col("a_area") - shared
    score = F.when(both > 0, shared / F.nullif(both, F.lit(0))).otherwise(0.0)
    return left.join(right, "page").where(touching).where((score >= least_iou) | inside).select("page", "det", "ans", F.round(score, 6).alias("iou"))


def centres_inside(found: DataFrame, areas: DataFrame) -> DataFrame:
    """page, det and ans of the boxes whose centre lies in an area of their page."""
    right = areas.select("page", "ans", *[F.col(s).alias(f"a_{s}") for s in SIDES])
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = cx.between(F.col("a_x1"), F.col("a_x2")) & cy.between(F.col("a_y1"), F.col("a_y2"))
    return found.join(right, "page").where(inside).select("page", "det", "ans")


def placed(spots: DataFrame, least: int, height: int) -> DataFrame:
    """Spots (w, h, y) that are large enough and end within a capture's height."""
    return spots.where((F.col("w") >= least) & (F.col("h") >= least) & (F.col("y") + F.col("h") <= height))


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table, so that the next round starts from it and outlives lost executors."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def assigned(pairs: DataFrame) -> DataFrame:
    """One detection for each answer and the other way round: answers in their order, each takes the first free detection in the order of listing.

    In rounds: a pair that is the first of its answer and of its detection is
    taken, and the other pairs of both go, until none is open.  Of pairs with
    equal numbers the greatest values count.
    """
    columns, done = pairs.columns, None
    keys = ["page", "ans", "det"]
    first = lambda key, other: F.min(other).over(Window.partitionBy("page", key))
    whole = pairs.where("page is not null and ans is not null and det is not null")
    others = [F.max(c).alias(c) for c in columns if c not in keys]
    open_ = whole.groupBy(*keys).agg(*others).select(*columns) if others else whole.distinct()
    while True:
        # the order of all pairs is by answer, then detection: a detection's first pair is its first answer's
        taken = (F.col("det") == first("ans", "det")) & (F.col("ans") == first("det", "ans"))
        marked = open_.withColumn("taken", taken)
        gone = lambda key: F.bool_or("taken").over(Window.partitionBy("page", key))
        marked = _written(marked.withColumns({"settled": gone("ans") | gone("det")}))
        now = marked.where("taken").select(*columns)
        done = now if done is None else done.unionByName(now)
        open_ = marked.where("not settled").select(*columns)
        if not open_.limit(1).count():
            return done


def _uncovered(found: DataFrame, covered) -> DataFrame:
    """Boxes by falling area without those that ``covered(shared, own, other's area)`` by an earlier one that stays.

    In rounds: a box that no open box covers stays, the boxes that it covers go,
    until all are settled; a box is covered by few, so rounds are few.
    """
    # rows by their place, so that equal numbers or boxes don't mix
    size_of = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    order = Window.partitionBy("page").orderBy(size_of.desc(), "det", *SIDES)
    numbered = _written(found.withColumn("__place", F.row_number().over(order)))
    sides = lambda p: [F.col(f"{p}{s}") for s in SIDES]
    size = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))
    plain = numbered.select("page", F.col("__place").alias("det"), *SIDES)
    other = plain.select("page", F.col("det").alias("by"), *[F.col(s).alias(f"o_{s}") for s in SIDES])
    before = F.col("by") < F.col("det")
    touching = (F.col("x1") < F.col("o_x2")) & (F.col("o_x1") < F.col("x2")) & (F.col("y1") < F.col("o_y2")) & (F.col("o_y1") < F.col("y2"))
    edges = _written(plain.join(other, "page").where(touching & before & covered(boxes.overlap(sides(""), sides("o_")), size(""), size("o_"))).select("page", "det", "by"))
    gone = None
    while True:
        waiting = edges.select("page", F.col("det").alias("by")).distinct()
        stays = edges.join(waiting, ["page", "by"], "left_anti")  # covered by a box that nothing open covers
        now = _written(stays.select("page", "det").distinct())
        gone = now if gone is None else gone.union(now)
        left = edges.join(now, ["page", "det"], "left_anti").join(now.withColumnRenamed("det", "by"), ["page", "by"], "left_anti")
        edges = _written(left.select("page", "det", "by"))
        if not edges.limit(1).count():
            return numbered.join(gone.withColumnRenamed("det", "__place"), ["page", "__place"], "left_anti").select(*found.columns)


def without_nested(found: DataFrame, page_area: float | None = None) -> DataFrame:
    """Boxes not 70 % inside a larger one that stays, nor half inside one of 60 % of the page (if its area is given)."""

    def covered(shared: Column, own: Column, area: Column) -> Column:
        inside = shared >= 0.7 * F.greatest(own, F.lit(1))
        return inside if page_area is None else inside | ((area >= 0.6 * page_area) & (shared >= 0.5 * F.greatest(own, F.lit(1))))

    return _uncovered(found, covered)


def without_duplicates(found: DataFrame) -> DataFrame:
    """Of boxes that are the same region (80 % of the smaller, 60 % of the larger) the larger one."""
    return _uncovered(found, lambda shared, own, area: (shared >= 0.8 * own) & (shared >= 0.6 * area))


def evaluation(found: DataFrame, answers: DataFrame, optional: DataFrame) -> DataFrame:
    """One row of totals against an answer key.

    ``found`` has page, det, the box, category, quality and confidence;
    ``answers`` page, ans, the box, category and also_ok; ``optional`` page, ans
    and the box.  A detection that is used by no answer and matches neither an
    answer nor an optional box is a false positive.
    """
    pairs = candidates(found, answers)
    used = assigned(pairs).select("page", "det", "ans")
    near = pairs.select("page", "det").union(candidates(found, optional).select("page", "det")).distinct()
    wrong = found.join(near, ["page", "det"], "left_anti").agg(F.count("*").alias("false_positives"))
    key = answers.select("page", "ans", F.col("category").alias("right"), "also_ok")
    met = used.join(found.select("page", "det", "category", "quality", "confidence"), ["page", "det"]).join(key, ["page", "ans"])
    fits = (F.col("category") == F.col("right")) | F.coalesce(F.array_contains("also_ok", F.col("category")), F.lit(False))
    totals = met.agg(F.count("*").alias("found"), F.count_if(fits).alias("category_ok"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 2).alias("quality"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 2).alias("confidence"))
    return totals.crossJoin(F.broadcast(wrong)).crossJoin(F.broadcast(answers.agg(F.count("*").alias("of"))))  # one row each


def runs(df: DataFrame, key: str, order: str, flag: Column, least: int) -> DataFrame:
    """Maximal runs of rows with the flag, at least this long: first, last and length."""
    marked = df.select(key, order, flag.cast("int").alias("on"))
    spans = marked.selectExpr(key, order, "on", f"row_number() over (partition by {key} order by {order}) - sum(on) over (partition by {key} order by {order} rows unbounded preceding) as island")
    return spans.where("on = 1").groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).where(F.col("length") >= least).drop("island")


def ad_score(layout: Column, ad_cues: Column, news_cues: Column) -> Column:
    return F.least(F.greatest(layout + 0.08 * F.least(ad_cues, F.lit(3)) - 0.15 * F.least(news_cues, F.lit(3)), F.lit(0.0)), F.lit(0.99))


def decided(blocks: DataFrame) -> DataFrame:
    """Blocks of a page (layout, ads, news, headline, full_text, page_share) with score, is_ad and likelihood.

    News wording without signs of ads and a missing headline on an unclear layout
    count against a block; a small one without text isn't an ad at all.
    """
    raw = F.col("layout") + 0.08 * F.least("ads", F.lit(3)) - 0.15 * F.least("news", F.lit(3))
    worded = F.when((F.col("news") >= 2) & (F.col("ads") == 0), 0.3).otherwise(0.0)
    silent = F.when((F.col("headline") == "") & (F.col("layout") < 0.7), 0.3).otherwise(0.0)
    empty = (F.length(F.replace("full_text", F.lit(" "), F.lit(""))) < 4) & (F.col("page_share") < 0.08)
    scored = blocks.withColumn("score", F.when(empty, 0.0).otherwise(raw - worded - silent))
    return scored.withColumns({"is_ad": F.col("score") >= 0.5, "likelihood": F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.5), "score")), 3)})


def cell_labels(cells: DataFrame, answers: DataFrame, optional: DataFrame) -> DataFrame:
    """Cells (page, cell, cx, cy) with label 1 inside an answer's box, and weight 0 inside an optional one alone."""
    areas = answers.select("page", *SIDES, F.lit(True).alias("sure")).unionByName(optional.select("page", *SIDES, F.lit(False).alias("sure"))).withColumnRenamed("page", "a_page")
    inside = (F.col("page") == F.col("a_page")) & F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))
    met = cells.join(areas, inside, "left").groupBy("page", "cell").agg(F.coalesce(F.bool_or("sure"), F.lit(False)).alias("sure"), F.count("sure").alias("n"))
    return met.select("page", "cell", F.col("sure").cast("int").alias("label"), F.when(~F.col("sure") & (F.col("n") > 0), 0.0).otherwise(1.0).alias("weight"))


def grid_counts(answers: DataFrame, optional: DataFrame, side: int, columns: int, rows: int) -> DataFrame:
    """For each page with boxes how many cells of a regular grid ``cell_labels`` gives label 1 (``positive``) and weight 0 (``ignored``).

    A box covers the same columns in each row that it reaches, so a page is a few
    numbers whose bits are its cells: no cell is a row of its own.
    """
    if columns > 62:
        raise ValueError("a row of the grid has to fit the bits of a number")
    each = 62 // columns  # rows of the grid in a number
    starts, none = range(0, rows, each), F.lit(0).cast("long")

    def reached(low: Column, high: Column, cells: int) -> tuple[Column, Column]:
        """The first and the last of the cells in a row whose middles lie from ``low`` to ``high``."""
        near = lambda v: F.least(F.greatest(v.cast("double"), F.lit(-1.0 * side)), F.lit((cells + 1.0) * side))
        first, last = F.ceil(near(low) / side - 0.5), F.floor(near(high) / side - 0.5)
        # a division may be off by a rounding, a comparison isn't
        first = first - ((first - 0.5) * side >= low).cast("int") + ((first + 0.5) * side < low).cast("int")
        last = last + ((last + 1.5) * side <= high).cast("int") - ((last + 0.5) * side > high).cast("int")
        return F.greatest(first, none), F.least(last, F.lit(cells - 1).cast("long"))

    def packed(boxes: DataFrame) -> DataFrame:
        """Each box's cells: in a number of some rows of the grid, a bit for each cell."""
        whole = F.col("x1").isNotNull() & F.col("x2").isNotNull() & F.col("y1").isNotNull() & F.col("y2").isNotNull()
        (left, right), (top, bottom) = reached(F.col("x1"), F.col("x2"), columns), reached(F.col("y1"), F.col("y2"), rows)
        spans = boxes.where("page is not null").select("page", whole.alias("whole"), left.alias("left"), right.alias("right"), top.alias("top"), bottom.alias("bottom"))
        one = F.lit(1).cast("long")
        bits = F.when(F.col("whole") & (F.col("right") >= F.col("left")), F.call_function("shiftleft", one, (F.col("right") + 1).cast("int")) - F.call_function("shiftleft", one, F.col("left").cast("int"))).otherwise(none)
        lines = spans.select("page", "top", "bottom", bits.alias("bits"))
        held = lambda at: sum((F.when((F.col("top") <= j) & (F.col("bottom") >= j), F.shiftleft("bits", columns * (j - at))).otherwise(none) for j in range(at, min(rows, at + each))), none)
        return lines.select("page", *[held(at).alias(f"c{at}") for at in starts])

    part = lambda boxes, own: packed(boxes).select("page", *[(F.col(f"c{at}") if name == own else none).alias(f"{name}{at}") for name in ("sure", "maybe") for at in starts])
    met = part(answers, "sure").unionByName(part(optional, "maybe"))
    met = met.groupBy("page").agg(*[F.bit_or(f"{name}{at}").alias(f"{name}{at}") for name in ("sure", "maybe") for at in starts])
    count = lambda of: sum((F.bit_count(of(at)).cast("long") for at in starts), none)
    return met.select("page", count(lambda at: F.col(f"sure{at}")).alias("positive"), count(lambda at: F.col(f"maybe{at}").bitwiseAND(F.bitwise_not(F.col(f"sure{at}")))).alias("ignored"))


def training_cells(labelled: DataFrame, most: int = 40_000) -> DataFrame:
    """The cells that count, at most ``most`` of them, drawn by a hash."""
    return labelled.where("weight > 0").orderBy(F.xxhash64("page", "cell"), "page", "cell").limit(most)
