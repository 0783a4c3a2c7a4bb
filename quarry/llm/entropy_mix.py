"""Mixing sources to target weights by entropy balancing. Built-in functions only.

Every document gets a rate: the numbers of copies closest to one copy each (in relative entropy) under the
constraint that each source's rates times sizes sum up to the source's target, with no rate above ``cap``.
The solution is ``min(cap, exp(l * size))`` with one multiplier ``l`` per source: the maximum of a concave dual
whose gradient is the source's words so far minus its target. So a source that shrinks keeps as many
documents as it can, and one that grows repeats as few as it can.

Documents enter only by (source, size), so they are counted into cells once, with partial sums before the
shuffle; each Newton step is one aggregation of the cells by source, its state a written table with a row per
source. Steps are taken on the logarithm of the words and kept inside a bracket that is known from the least
and the greatest size; every third step outside convergence halves the bracket instead. Sums of doubles are taken as
decimals, so that they do not depend on the order of rows and reruns agree.

Rates become copies per cell by rounding their running sum over falling sizes (so that at most one copy is
owed at any size), then the words still owed are made up by cells of the largest sizes that fit. Within a cell the
documents of the lowest id hashes get the copy that does not divide evenly. Hot cells are numbered by bucket.

Sizes count ``[^\\x20\\x09-\\x0D]+`` words. Defined results: NULL and empty texts have size 0 and one copy (no words). A
NULL source is a source of its own, the last one. Rows that repeat an id are documents of their own; NULL ids
are ids like any other. An empty table gives an empty mix. Sources without words have target 0. Extra columns
are ignored by ``plan`` and kept by ``expand``; columns named like a result are replaced by it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialise

#: Documents of one cell that are numbered together, and rows that one row of counts is spread to in one task.
BUCKET = 50_000
EXACT = "decimal(38,6)"


def word_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` words of a text column (0 for NULL)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """``sid`` (number of the source by code point, NULL last), source, source_size, target from (source, size).

    The weights repeat over the sources and share all words; a target stops at ``cap`` times its source's size
    and the excess is shared again by weight until none is above.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = totals.repartitionByRange(F.col("source").asc_nulls_last())
    ranged = materialise(ranged.select("source", "source_size", F.spark_partition_id().alias("part")), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    base = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    order = ranged.withColumn("at", at).join(base, "part").select((F.col("base") + F.col("at")).alias("sid"), "source", "source_size")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    state = materialise(order.withColumn("weight", weight).withColumn("full", F.lit(False)), "mix-sources")
    limit = F.col("source_size") * F.lit(float(cap))
    while True:
        one = state.agg(F.sum("source_size").alias("total"), F.sum(F.when(F.col("full"), limit)).alias("used"),
                        F.sum(F.when(~F.col("full"), F.col("weight"))).alias("weight")).first()
        level = ((one.total or 0) - (one.used or 0.0)) / one.weight if one.weight else 0.0
        share = F.col("weight") * F.lit(level)
        over = ~F.col("full") & (share > limit)
        if state.where(over).isEmpty():
            break
        state = materialise(state.withColumn("full", F.col("full") | over), "mix-sources")
    return state.select("sid", "source", "source_size", F.when(F.col("full"), limit).otherwise(share).alias("target"))


def solve(cells: DataFrame, targets: DataFrame, cap: int = 3, tolerance: float = 1e-7) -> DataFrame:
    """``sid``, ``l``: the multiplier of every source, from cells (sid, size > 0, n) and targets (sid, target).

    NULL marks rates that do not depend on the size: all ``cap`` (target at or above the cap) or all 0 (target 0);
    the column ``flat`` then holds that rate.
    """
    size, n = F.col("size").cast("double"), F.col("n").cast("double")
    known = cells.groupBy("sid").agg(F.sum((n * size).cast(EXACT)).cast("double").alias("all"), F.min("size").alias("least"),
                                     F.max("size").alias("most"), F.sum((n * size * size).cast(EXACT)).cast("double").alias("square"))
    state = known.join(targets.select("sid", "target"), "sid")
    ratio = F.col("target") / F.col("all")
    flat = F.when(ratio >= cap, F.lit(float(cap))).when(ratio <= 0, F.lit(0.0))
    log = F.abs(F.log(ratio))
    # the multiplier's size lies in [lo, hi], its sign is that of log(ratio)
    state = state.select("sid", "target", flat.alias("flat"), F.when(ratio > 1, 1.0).otherwise(-1.0).alias("sign"),
                         (log / F.col("most")).alias("lo"),
                         F.when(ratio > 1, F.lit(math.log(cap)) / F.col("least")).otherwise(log / F.col("least")).alias("hi"),
                         (log * F.col("all") / F.col("square")).alias("m"))
    inside = F.least(F.greatest("m", "lo"), F.col("hi"))
    state = state.withColumn("m", F.when(F.col("flat").isNull(), inside))
    state = materialise(state.withColumn("done", F.col("flat").isNotNull() | F.col("m").isNull() | (F.col("m") == 0)), "mix-newton")
    step = 0
    while not state.where(~F.col("done")).isEmpty():
        rate = F.exp(F.col("sign") * F.col("m") * size)
        here = cells.join(state.where(~F.col("done")).select("sid", "sign", "m"), "sid")
        here = here.groupBy("sid").agg(F.sum((n * size * F.least(rate, F.lit(float(cap)))).cast(EXACT)).cast("double").alias("words"),
                                       F.sum(F.when(rate < cap, n * size * size * rate).otherwise(0.0).cast(EXACT)).cast("double").alias("slope"))
        state = materialise(_stepped(state.join(here, "sid", "left"), tolerance, step % 3 == 2), "mix-newton")
        step += 1
    return state.select("sid", (F.col("sign") * F.col("m")).alias("l"), "flat")


def _stepped(state: DataFrame, tolerance: float, halve: bool) -> DataFrame:
    """One safeguarded Newton step on log(words) for the sources that are not done."""
    words, target, m, lo, hi, sign = (F.col(c) for c in ("words", "target", "m", "lo", "hi", "sign"))
    short = (words < target) == (sign > 0)  # the multiplier's size has to grow
    low, high = F.when(short, m).otherwise(lo), F.when(short, hi).otherwise(m)
    newton = m - sign * F.log(words / target) * words / F.col("slope")
    middle = F.sqrt(low * high)
    usable = (newton > low) & (newton < high) & ~F.lit(halve)
    close = (F.abs(words / target - 1) <= tolerance) | (high - low <= high * 1e-15)
    next_ = F.when(close, m).otherwise(F.when(usable, newton).otherwise(middle))
    keep = lambda new, old: F.when(F.col("done"), old).otherwise(new)
    return state.select("sid", "target", "flat", "sign", keep(low, lo).alias("lo"), keep(high, hi).alias("hi"),
                        keep(next_, m).alias("m"), keep(close, F.lit(True)).alias("done"))


def round_copies(cells: DataFrame, multipliers: DataFrame, targets: DataFrame, cap: int = 3) -> DataFrame:
    """Cells (sid, size, n) with ``rate`` and ``copies`` of all their documents together, at most ``cap * n``."""
    rate = F.coalesce("flat", F.least(F.exp(F.coalesce("l", F.lit(0.0)) * F.col("size")), F.lit(float(cap))))
    cells = cells.join(multipliers, "sid").select("sid", "size", "n", rate.alias("rate"))
    down = Window.partitionBy("sid").orderBy(F.desc("size"))  # a row per distinct size
    sofar = F.floor(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    copies = F.col("sofar") - F.lag("sofar", 1, 0).over(down)
    cells = cells.withColumn("sofar", sofar).withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n") * cap))
    cells = materialise(cells.drop("sofar"), "mix-cells")
    want = targets.select("sid", F.round("target").cast("long").alias("want"))
    while True:
        owed = cells.groupBy("sid").agg(F.sum(F.col("copies") * F.col("size")).alias("have")).join(want, "sid")
        owed = owed.select("sid", (F.col("want") - F.col("have")).alias("owed")).where("owed <> 0")
        room = F.when(F.col("owed") > 0, F.col("n") * cap - F.col("copies")).otherwise(F.col("copies"))
        fit = cells.join(owed, "sid").where(F.col("size") <= F.abs("owed")).withColumn("room", room).where("room > 0")
        # largest sizes first: all that fits, then as many of the first cell that does not as still fit
        filled = F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("room") * F.col("size")
        fit = fit.withColumn("free", F.abs("owed") - filled).where(F.col("free") >= F.col("size"))
        move = F.least("room", F.expr("free div size")) * F.signum(F.col("owed").cast("double")).cast("long")
        moves = materialise(fit.select("sid", "size", move.alias("move")), "mix-moves")
        if moves.isEmpty():  # nothing fits: one document too many (or too few), where that comes nearer
            near = cells.join(owed, "sid").where(F.col("size") < 2 * F.abs("owed")).where(room > 0)
            near = near.groupBy("sid").agg(F.min("size").alias("size"), F.first(F.signum(F.col("owed").cast("double")).cast("long")).alias("move"))
            moves = materialise(near, "mix-moves")
            if moves.isEmpty():
                return cells
        cells = cells.join(moves, ["sid", "size"], "left")
        cells = materialise(cells.select("sid", "size", "n", "rate", (F.col("copies") + F.coalesce("move", F.lit(0))).alias("copies")), "mix-cells")


def plan(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", source_col: str = "source",
         text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, source, size, source_size, target, rate, copies, taken (= copies * size)."""
    sizes = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"))
    sizes = materialise(sizes, "mix-sizes")
    targets = materialise(source_targets(sizes, weights, cap), "mix-targets")
    cells = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    numbered = targets.select("sid", F.col("source").alias("of"))
    cells = cells.join(numbered, F.col("source").eqNullSafe(F.col("of"))).select("sid", "source", "size", "n")
    cells = materialise(cells, "mix-cells")
    full = cells.where("size > 0").select("sid", "size", "n")
    done = round_copies(full, solve(full, targets, cap), targets, cap)
    done = cells.join(done.drop("n"), ["sid", "size"], "left").join(targets.select("sid", "source_size", "target"), "sid")
    done = done.select("sid", F.col("source").alias("of"), F.col("size").alias("words"), "n", "source_size", "target",
                       F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce("copies", F.col("n")).alias("all_copies"))
    # rows of one id and cell are alike; they are counted, numbered by the id's hash and given out as rows again
    alike = sizes.groupBy("id", "source", "size").agg(F.count("*").alias("rows"))
    alike = alike.join(done, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("words"))).drop("of", "words")
    alike = alike.withColumn("each", F.expr("all_copies div n")).withColumn("more", F.expr("all_copies % n"))
    even, odd = alike.where("more = 0").withColumn("extra", F.lit(0).cast("long")), alike.where("more > 0")
    odd = odd.withColumn("bucket", F.pmod(F.xxhash64("id"), F.expr(f"1 + n div {BUCKET}")))
    sums = odd.groupBy("sid", "size", "bucket").agg(F.sum("rows").alias("here"))
    ahead = Window.partitionBy("sid", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "size", "bucket", F.coalesce(F.sum("here").over(ahead), F.lit(0)).alias("base"))
    first = Window.partitionBy("sid", "size", "bucket").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    odd = odd.withColumn("at", F.coalesce(F.sum("rows").over(first), F.lit(0))).join(sums, ["sid", "size", "bucket"])
    extra = F.greatest(F.least(F.col("more") - F.col("base") - F.col("at"), F.col("rows")), F.lit(0))
    names = ["id", "source", "size", "source_size", "target", "rate", "rows", "each", "extra"]
    dealt = materialise(even.select(names).unionByName(odd.withColumn("extra", extra).select(names)), "mix-dealt")
    many = dealt.where(F.col("rows") > BUCKET).withColumn("piece", F.explode(F.expr(f"sequence(0, (rows - 1) div {BUCKET})"))).repartition("id", "piece")
    before = F.col("piece") * BUCKET
    many = many.withColumn("extra", F.greatest(F.col("extra") - before, F.lit(0))).withColumn("rows", F.least(F.col("rows") - before, F.lit(BUCKET)))
    out = dealt.where(F.col("rows") <= BUCKET).unionByName(many.select(names))
    out = out.withColumn("number", F.explode(F.expr("sequence(1L, rows)")))
    copies = F.col("each") + (F.col("number") <= F.col("extra")).cast("long")
    return out.select("id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def expand(df: DataFrame, planned: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix: the rows of ``df``, each as often as ``planned`` says, with ``copy`` numbering a row's copies from 1.

    Rows without copies are gone. Rows that share id, source and size share their copies out by the hash of their texts;
    rows whose texts are equal too count as one row (any one of them) with all their copies.
    """
    rest = [c for c in df.columns if c.lower() != "copy"]
    size, body = word_count(F.col(f"`{text_col}`")), F.xxhash64(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), body.alias("body"),
                     F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    rows = rows.groupBy("id", "source", "size", "body").agg(F.count("*").alias("rows"), F.any_value("row").alias("row"))
    given = planned.groupBy("id", "source", "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("of"))
    given = given.select(*[F.col(c).alias(f"{c}_") for c in ("id", "source", "size")], "copies", "of")
    on = F.col("id").eqNullSafe(F.col("id_")) & F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))
    first = Window.partitionBy("id", "source", "size").orderBy("body").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(given, on).withColumn("at", F.coalesce(F.sum("rows").over(first), F.lit(0)))
    share = F.expr("rows * (copies div of) + greatest(least(copies % of - at, rows), 0)")
    rows = rows.withColumn("share", share).where("share > 0").withColumn("copy", F.explode(F.expr("sequence(1L, share)")))
    return rows.select(*[F.col("row")[c].alias(c) for c in rest], "copy")
