"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. The rates of its documents are the exponential tilt
``rate = min(cap, exp(lambda * size / scale))`` whose expected words meet the target: the multiplier
of the convex dual, found for all sources at once by guarded Newton steps over (source, size) counts.
Rates become whole copies by systematic rounding along each source's sizes, so a source misses its
target by little more than one document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafoot.llm.common import cut, n_words, ranked
from terrafoot.session import released

#: Rows of one (source, size) cell that one task may number.
CELL_ROWS = 512
CELL = ["skey", "size"]
STEPS = 80
CLOSE = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From rows (skey, null_source, source, source_size): adds weight and target, one row per source.

    Sources take the weights in turn by code point, null last. They share ``share`` times all words
    by weight; what a source would get above ``cap`` times its own words is shared again.
    """
    rows = ranked(sizes, F.col("null_source"), F.col("source"), name="__rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = cut(rows.withColumn("weight", weight), "mix-sources")
    budget = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    limit, level, full = cap * F.col("source_size"), 0.0, -1
    while True:  # one aggregate a round; ends when no further source is at its limit
        at_limit = limit <= F.lit(level) * F.col("weight")
        n, held, free = rows.agg(F.count_if(at_limit), F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("weight")))).first()
        if n == full or not free:
            break
        full, level = n, max(level, (budget - (held or 0.0)) / free)
    return cut(rows.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")) if budget else F.lit(0.0)), "mix-targets")


def _rate(cap: float) -> Column:
    tilt = F.exp(F.least(F.col("lam") * F.col("z"), F.lit(math.log(cap))))
    return F.when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(tilt)


def _multipliers(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(skey, lam, target, source_size, scale): the dual's solution per source, by Newton steps kept inside a bracket."""
    facts = cells.where("size > 0").groupBy("skey").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("scale"), F.min("size").alias("least"))
    state = targets.join(facts, "skey").where("target > 0")
    top = F.lit(math.log(cap)) * F.col("scale") / F.col("least")
    state = cut(state.select("skey", "target", "source_size", "scale", top.alias("hi"), (-60 * F.col("scale") / F.col("least")).alias("lo"), F.least(F.log(F.col("target") / F.col("source_size")), top).alias("lam"), F.lit(False).alias("still")), "mix-dual")
    for _ in range(STEPS):
        rows = cells.where("size > 0").join(state.where("NOT still"), "skey").withColumn("z", F.col("size") / F.col("scale"))
        words = F.col("n") * F.col("size") * _rate(cap)
        slope = F.when(F.col("lam") * F.col("z") < math.log(cap), words * F.col("z")).otherwise(0.0)
        sums = rows.groupBy("skey").agg(F.sum(words).alias("got"), F.sum(slope).alias("slope"))
        moved = state.join(sums, "skey", "left")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        moved = moved.withColumns({"lo": F.when(F.col("still"), F.col("lo")).otherwise(lo), "hi": F.when(F.col("still"), F.col("hi")).otherwise(hi), "still": F.col("still") | (F.abs(miss) <= CLOSE * F.col("target")) | (F.col("target") >= cap * F.col("source_size"))})
        step = F.col("lam") - miss / F.col("slope")
        inside = (F.col("slope") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        lam = F.when(F.col("still"), F.col("lam")).when(inside, F.when(F.col("slope") > 0, step)).otherwise((F.col("lo") + F.col("hi")) / 2)
        old, state = state, cut(moved.withColumn("lam", lam).select("skey", "target", "source_size", "scale", "hi", "lo", "lam", "still"), "mix-dual")
        released(old)
        if state.where("NOT still").isEmpty():
            break
    return state


def tilted_rates(cells: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(skey, size, n, source_size, target, rate) of each cell (skey, size, n): one multiplier a source tilts all its rates."""
    dual = _multipliers(cells, targets, cap)
    rates = cells.join(targets, "skey").join(dual.select("skey", "lam", "scale"), "skey", "left").withColumn("z", F.col("size") / F.col("scale"))
    rates = rates.withColumn("rate", F.when((F.col("size") > 0) & (F.col("target") > 0), F.least(_rate(cap), F.lit(cap))).otherwise(0.0))
    return rates.select("skey", "size", "n", "source_size", "target", "rate")


def salted(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their part of a salt, and the rows of each part; a salt has several only where ids repeat or are null.

    Hashes of distinct ids fill a salt with about CELL_ROWS rows; what is far above that is dealt by the rows' places.
    """
    key = [*CELL, "salt", "part_of"]
    dealt = cut(dealt.withColumn("part_of", F.lit(0).cast("long")), "mix-dealt")
    counts = cut(dealt.groupBy(*key).agg(F.count("*").alias("here")), "mix-salts")
    hot = counts.where(F.col("here") > 4 * CELL_ROWS)
    if not hot.isEmpty():
        pieces = hot.select(*key[:3], F.ceil(F.col("here") / CELL_ROWS).alias("pieces"))
        place = F.coalesce(F.pmod(F.xxhash64("row"), F.col("pieces")), F.lit(0)).cast("long")
        dealt = cut(dealt.drop("part_of").join(pieces.hint("merge"), key[:3], "left").withColumn("part_of", place).drop("pieces"), "mix-parts")
        counts = cut(dealt.groupBy(*key).agg(F.count("*").alias("here")), "mix-salts")
    return dealt, counts


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0, carry: bool = False) -> DataFrame:
    """One row per document: __id, __size, __source_size, __target, __copies; with ``carry`` its own columns too.

    A null or empty text, or one without words, has size 0 and no copies. A null source is a source
    of its own, the last. Equal rows are separate documents. Copies are at most ``cap`` rounded up.
    An empty table gives no rows. The same input gives the same copies: ties are broken by a hash
    of the id, then by the row's place in the input files.

    Only (id, source, size) is shuffled. A cell of very many documents of one source and size is
    numbered in salted parts of about 512 rows, by the id's hash, and rows that share an id, or have
    none, by their place in the input; the running sums run over distinct sizes. Texts of any
    length are read whole.
    """
    source = F.col(source_col)
    skey = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    own = [F.struct(*[F.col(c) for c in docs.columns]).alias("__carried")] if carry else []
    rows = cut(docs.select(*own, F.col(id_col).alias("__id"), source.alias("__source"), skey.alias("skey"), n_words(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    cells = cut(rows.groupBy("skey", "__source", "size").agg(F.count("*").alias("n")), "mix-cells")
    sizes = cells.groupBy("skey", F.col("__source").isNull().alias("null_source"), F.col("__source").alias("source")).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = source_targets(sizes, weights, share, cap).select("skey", "source_size", "target")
    rates = tilted_rates(cells.select("skey", "size", "n"), targets, cap)
    rates = rates.withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    before = Window.partitionBy("skey").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = rates.withColumn("gone", F.coalesce(F.sum(F.col("n") * F.col("part")).over(before), F.lit(0.0)))
    rates = cut(rates.select("skey", "size", "n", "whole", "part", "gone", "source_size", "target"), "mix-rates")
    salts = F.ceil(F.col("n") / CELL_ROWS)
    dealt = rows.select("__id", "skey", "size", "row").join(rates, ["skey", "size"]).withColumn("hash", F.xxhash64("__id"))
    dealt, counts = salted(dealt.withColumn("salt", F.pmod(F.col("hash"), salts)))
    key = [*CELL, "salt", "part_of"]
    offset = F.coalesce(F.sum("here").over(Window.partitionBy("skey", "size").orderBy("salt", "part_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("offset", offset).drop("here")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("hash", "__id", "row"))
    dealt = dealt.join(counts, key).withColumn("place", F.col("offset") + place - 1)
    reach = F.col("gone") + F.col("place") * F.col("part") + 0.5
    copies = (F.col("whole") + F.floor(reach + F.col("part")) - F.floor(reach)).cast("long")
    out = dealt.select("row", "__id", F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), copies.alias("__copies"))
    if carry:
        out = rows.select("row", "__carried").join(out, "row").select("__carried.*", "__id", "__size", "__source_size", "__target", "__copies")
    return out.drop("row")
