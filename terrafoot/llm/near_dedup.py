"""Near duplicates: fast similarity sketches, banding, exact verification, connected components.

Texts with equal shingle sets become one class first, so groups of copies never meet as pairs.
Classes that share a band are compared with one pivot of the bucket; what is linked to a pivot by an
exact check of the full sets falls into its component. Members of one bucket that are still in
different components meet further pivots, and in the end the nodes outside the main component are
compared with the others of their pivot, in blocks that hold a bounded number of shingles. Pivots of
very many blocks first lose the nodes that share no prefix shingle with another component: two sets
of the wanted similarity always share one of the first n - ceil(0.8 n) + 1 of their shingles, in any
fixed order, and here the order puts those that are frequent at the pivot last. So every pair of
classes that shares a band is checked or known to be connected or too far apart, no pair but the
links leaves a block, and no bucket emits all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafoot.llm.common import buffers, cut, pieces
from terrafoot.llm.words import PIECE, band_keys, fast_sketches, shingle_sets
from terrafoot.session import released

#: At a similarity of 0.8 a pair shares one of 40 bands of 6 coordinates with probability 0.999995.
BANDS, ROWS = 40, 6
#: Rounds with further pivots, at most, before what is left in mixed buckets is compared in blocks.
PIVOT_ROUNDS = 4
#: Shingles on either side of a block that one task compares; a longer set stands alone. Near copies share most of them,
#: so this bounds a task's work as well as its memory.
BLOCK = 1 << 16
#: Where a set would go to more blocks than this, nodes that can't be linked are found first, which costs about as much.
COPIES = 16


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column("text"))
            for s, e in pieces(at, PIECE):
                sets = shingle_sets(at[s : e + 1] - at[s], data[at[s] : at[e]], k)
                keys = band_keys(fast_sketches(sets, bands * rows), rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[s:e],
                        batch.column("mark")[s:e],
                        pa.array([len(x) for x in sets], pa.int32()),
                        pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(e - s + 1) * bands, pa.int32()), pa.array(keys.ravel())),
                    ],
                    ["id", "mark", "n", "digest", "bands"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, data = buffers(batch.column("text"))
            for s, e in pieces(at, PIECE):
                sets = shingle_sets(at[s : e + 1] - at[s], data[at[s] : at[e]], k)
                ends = np.cumsum([0, *(len(x) for x in sets)])
                yield pa.RecordBatch.from_arrays([batch.column("node")[s:e], pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))).cast(pa.list_(pa.int64()))], ["node", "shingles"])

    return run


def _links(similarity: int):
    """The pairs of a block that are similar enough and in different components: asked nodes against the others."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asked, others = rows[rows.asked], rows[~rows.asked]
        tokens = np.concatenate([*others.shingles, np.zeros(0, np.int64)]).astype(np.int64)
        sizes = np.array([len(x) for x in others.shingles], np.int64)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(others)), sizes)[order]
        nodes, comps, out = others.node.to_numpy(), others.comp.to_numpy(), []
        for node, comp, own in zip(asked.node, asked.comp, asked.shingles, strict=True):
            own = np.asarray(own, np.int64)
            first, last = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            spot = np.repeat(first - np.concatenate([[0], np.cumsum(last - first)[:-1]]), last - first) + np.arange((last - first).sum())
            common = np.bincount(owner[spot], minlength=len(others))
            near = (100 * common >= similarity * (len(own) + sizes - common)) & (comps != comp)
            out += [(min(node, x), max(node, x)) for x in nodes[near].tolist()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of ``edges`` (a, b): comp is the smallest node of its component.

    Alternates the large-star and small-star steps until the edges are stars, which takes a number
    of rounds logarithmic in the component's size. Stars' hubs are joined as skewed keys.
    """
    stars = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    while True:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(stars.select("lo", "hi"))
        near = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "star-min")
        large = cut(both.join(near, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "star-large")
        least = cut(large.groupBy("hi").agg(F.min("lo").alias("m")), "star-min")
        small = large.join(least, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, stars = stars, cut(small.unionAll(least.select("hi", F.col("m").alias("lo"))).distinct(), "star-small")
        released(old, near, large, least)
        ends = stars.select(F.col("hi").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(stars.select("lo", F.lit(0), F.lit(1)))
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if loose.isEmpty():  # every node has one edge up, to a node that has none
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).unionAll(stars.select("lo", "lo").distinct())


def _may_meet(stars: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(pivot, node) of the nodes of ``stars`` (pivot, node, comp, size, n) that share a prefix shingle with another component.

    A pivot's frequent shingles, those of a tenth of its nodes or more, number ten times a mean set at most.
    """
    rows = cut(stars.join(sets.hint("merge"), "node").select("pivot", "node", "comp", "size", "n", "shingles"), "star-sets")
    counts = rows.select("pivot", "size", F.explode("shingles").alias("token")).groupBy("pivot", "size", "token").agg(F.count("*").alias("held"))
    frequent = cut(counts.where("10 * held >= size").groupBy("pivot").agg(F.collect_list("token").alias("frequent")), "star-frequent")
    last = F.coalesce("frequent", F.array().cast("array<long>"))
    ordered = F.concat(F.array_sort(F.array_except("shingles", last)), F.array_sort(F.array_intersect("shingles", last)))
    prefix = F.slice(ordered, F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity / 100) + 1).cast("int"))
    keyed = cut(rows.join(frequent.hint("merge"), "pivot", "left").select("pivot", "node", "comp", F.explode(prefix).alias("token")), "star-prefixes")
    shared = keyed.groupBy("pivot", "token").agg(F.min("comp").alias("first"), F.max("comp").alias("last")).where("first != last")
    return keyed.join(shared.select("pivot", "token").hint("merge"), ["pivot", "token"], "left_semi").select("pivot", "node").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, similarity: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, mark, n_shingles, component_id.

    Words are runs without white space, A-Z in lower case; a text's set holds its distinct k-word
    shingles, or its whole word sequence if shorter. Texts without words, empty and null texts have
    an empty set and are linked with nothing. Texts are linked when 100 * intersection is at least
    ``similarity`` * union; component_id is the smallest id reachable. Null ids are never the
    smallest; a component of null ids only has a null component_id. Rows that share an id but not
    their text are separate nodes; ``mark`` tells them apart. An empty table gives no rows. Texts and
    words of any length are read whole.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("mark"), F.col(text_col).alias("text"))
    rows_ = cut(texts.mapInArrow(_sketch(k, bands, rows), "id long, mark long, n int, digest binary, bands array<long>"), "sketches")
    classes = rows_.where("n > 0").groupBy("digest").agg(F.min("id").alias("least_id"), F.min(F.struct("id", "mark")).alias("where"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("node", "n", F.explode("bands").alias("band"))
    buckets = cut(keyed.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("pivot")).where("size > 1"), "buckets")
    members = cut(keyed.join(buckets.select("band", F.col("pivot.node").alias("pivot"), F.col("pivot.n").alias("pivot_n")).hint("merge"), "band"), "members")
    need = members.select("node").distinct().join(classes.select("node", "where"), "node")
    need = need.select("node", F.col("where.id").alias("at_id"), F.col("where.mark").alias("at_mark"))
    sets = texts.join(need.hint("merge"), (F.col("mark") == F.col("at_mark")) & F.col("id").eqNullSafe(F.col("at_id"))).select("node", "text")
    sets = cut(sets.mapInArrow(_full_sets(k), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    def compared(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        common = F.size(F.array_intersect("set_a", "set_b"))
        near = 100 * common >= similarity * (F.size("set_a") + F.size("set_b") - common)
        return cut(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", near.alias("linked")), "checked")

    def alike(n: str, m: str) -> Column:
        """Whether sets of these sizes can be similar enough."""
        return 100 * F.least(n, m) >= similarity * F.greatest(n, m)

    def placed() -> tuple[DataFrame, DataFrame]:
        """Members of the buckets that hold several components, and those buckets."""
        rows = members.select("band", "pivot", "node", "n").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        parts = rows.groupBy("band", "comp").agg(F.count("*").alias("size"), F.min_by(F.struct("node", "n"), F.xxhash64(F.col("node"), F.lit(turn))).alias("some"))
        mixed = cut(parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("size").alias("rows"), F.max(F.struct("size", "comp", "some")).alias("most")).where("parts > 1"), "mixed")
        return cut(rows.join(mixed.select("band", F.col("most.comp").alias("main"), F.col("most.some.node").alias("turn_pivot"), F.col("most.some.n").alias("turn_n")), "band"), "mixed-members"), mixed

    # every member against its bucket's pivot, then those outside the main component against further pivots of it
    pairs = members.where((F.col("node") != F.col("pivot")) & alike("n", "pivot_n")).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    checked, turn, before = compared(pairs), 0, None
    while True:
        labels = connected(checked.where("linked"))
        rows, mixed = placed()
        total, outside = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.col("rows") - F.col("most.size")), F.lit(0))).first()
        if turn == PIVOT_ROUNDS or (before is not None and outside > 0.8 * before) or 2 * outside <= total:
            break  # main components hold most of their buckets, or further pivots don't help
        turn, before = turn + 1, outside
        pairs = rows.where((F.col("comp") != F.col("main")) & alike("n", "turn_n")).select(F.least("node", "turn_pivot").alias("a"), F.greatest("node", "turn_pivot").alias("b")).distinct()
        pairs = cut(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        checked = checked.unionAll(compared(pairs))

    # what is left: the nodes of a pivot's buckets that are outside their main component, against all of its nodes, in blocks
    stars = rows.select("pivot", "node", "comp", "n").distinct()
    parts = stars.groupBy("pivot", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("weight"))
    stats = parts.groupBy("pivot").agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"), F.max(F.struct("size", "comp", "weight")).alias("most")).where("size > 2")
    blocks = lambda weight: F.greatest(F.lit(1), F.ceil(weight / BLOCK))
    stats = stats.select("pivot", "size", F.col("most.comp").alias("main"), blocks(F.col("weight")).alias("across"), blocks(F.col("weight") - F.col("most.weight")).alias("down"))
    stats = cut(stats, "star-stats")
    stars = cut(stars.join(stats.hint("merge"), "pivot"), "stars")
    if not stats.where(F.col("across") + F.col("down") > COPIES).isEmpty():
        large = stars.where(F.col("across") + F.col("down") > COPIES)
        left = cut(large.drop("across", "down").join(_may_meet(large, sets, similarity).hint("merge"), ["pivot", "node"], "left_semi"), "stars-left")
        outside = F.sum(F.when(F.col("comp") != F.col("main"), F.col("n")).otherwise(0))
        shares = cut(left.groupBy("pivot").agg(blocks(F.sum("n")).alias("across"), blocks(outside).alias("down")), "star-stats")
        stars = stars.where(F.col("across") + F.col("down") <= COPIES).unionByName(left.join(shares.hint("merge"), "pivot"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = stars.where("comp != main").select("pivot", "node", "comp", F.lit(True).alias("asked"), block("down").alias("i"), every("across").alias("j"))
    dealt = asked.unionAll(stars.select("pivot", "node", "comp", F.lit(False), every("down"), block("across")))
    found = dealt.join(sets.hint("merge"), "node").groupBy("pivot", "i", "j").applyInPandas(_links(similarity), "a long, b long")
    found = cut(found.distinct(), "links")
    if not found.isEmpty():
        labels = connected(checked.where("linked").select("a", "b").unionAll(found))
    named = classes.select("digest", "node", "least_id").join(labels, "node", "left")
    ids = cut(named.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least_id").alias("component_id")), "component-ids")
    named = named.join(ids, "comp", "left").select("digest", F.coalesce("component_id", "least_id").alias("component_id"))
    named = cut(named, "class-components")
    linked = rows_.where("n > 0").join(named.hint("merge"), "digest").select("id", "mark", "n", "component_id")
    found = linked.unionAll(rows_.where("n = 0").select("id", "mark", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias("doc_id"), "mark", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id.

    Of rows with equal id and text one stays. Rows with a null id stay only where their whole
    component has no id, one for each distinct text.
    """
    groups = near_groups(docs, id_col, text_col, **how)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(text_col, F.lit(""))))
    rows = rows.join(stay.hint("merge"), (F.col("__own") == F.col("__mark")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")))
    return rows.dropDuplicates(["__id", "__own"]).select(*docs.columns)
