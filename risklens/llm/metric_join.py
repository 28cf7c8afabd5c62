"""Metric-space join by pivots: Voronoi regions, windows, recursion.

Input are star pairs (pivot, member): two items that link are together in the
region of at least one pivot, or in regions whose pivots are together in one.
The work of ``connect``:

1. Measure every member's distance to its region's pivot. Members within the
   radius link to it, and so to each other, without a test of their pairs.
2. A region whose members are all in one component is finished. The members of
   the others, and of regions around them, are open: boundary items, which may
   have links across components.
3. The open items are dealt into finer regions (``refine``). In each, the
   largest component is the inside and the other members are the outside. Where
   more than SMALL members are outside, the region is cut: pivots are drawn and
   measured against all members, every member goes to its nearest pivot's cell
   and, where its distance is within twice the radius of the nearest, to that
   pivot's cell too, so by the triangle inequality both ends of a link share a
   cell. Cells are cut again, up to LEVELS times, while that makes them smaller.
4. In the regions that remain, outside members are compared with members of
   other components that ``may_link`` and the windows don't rule out: ends of a
   link differ by at most ``width`` in size and by at most the radius in their
   distance to the cell's pivot. With ``may_meet``, regions of up to MOST
   pairs are compared by a join; in larger ones blocks of members meet, and only links
   that join components leave them.

No link between different components is lost, whatever the sizes; links inside
one component aren't all listed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.bloom import id_filter
from risklens.llm.common import batch_rows, stored, stored_parts
from risklens.llm.components import components

#: A region with at most so many members outside its largest component is
#: compared directly; others are cut by about PIVOTS pivots, at most LEVELS times.
SMALL = 64
PIVOTS = 8
LEVELS = 4
#: Pairs (outside members x members) of a region up to which a join lists them, and
#: members of a block in the others.
MOST = 2048
WIDE_BLOCK = 2048
#: Members of a block, where regions are compared block by block: their pairs are
#: never rows.
BLOCK = 256
#: Cells must hold no more than so many times their region's members.
OVERLAP = 2.0
SLACK = 1e-9

MEASURED = "a long, b long, link boolean, d double"


def measure(spark: SparkSession, pairs: DataFrame, items: DataFrame, distance: Callable, portions: int = 1) -> DataFrame:
    """(a, b, link, d) of ``pairs`` (a, b): ``distance(payload, payload)`` gives
    (link, d). Pairs are written in ``portions`` (by b), one after the other, so the
    payloads of one portion at a time are on disk. Payloads meet by joins on a and b; a hot pivot's pairs are split
    by the adaptive skew join."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("link", pa.bool_()), ("d", pa.float64())])

    def run(batches) -> Iterator[dict]:
        for t in batches:
            got = [distance(x, y) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]
            yield {"a": t.column(0), "b": t.column(1), "link": [bool(g[0]) for g in got], "d": [float(g[1]) for g in got]}

    def portion(k: int) -> DataFrame:
        mine, right = pairs.select("a", "b"), items.select(F.col("id").alias("b"), F.col("payload").alias("pb"))
        left = items.select(F.col("id").alias("a"), F.col("payload").alias("pa"))
        if portions > 1:
            own = F.pmod(F.xxhash64("b"), F.lit(portions)) == k
            mine, right = mine.where(own), right.where(own)
            left = left.join(mine.select("a").distinct(), "a", "left_semi")
        both = mine.join(left, "a").join(right, "b").select("a", "b", "pa", "pb")
        return both.mapInArrow(batch_rows(run, schema), MEASURED)

    return stored_parts(spark, (portion(k) for k in range(portions)), "measured")


def filtered(spark: SparkSession, rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``rows`` (id, ...) whose id is among ``ids`` (id), and perhaps a few more: a
    filter of bounded size goes to the tasks, so payloads aren't shuffled to find them."""
    among, at = id_filter(spark, ids), rows.columns.index("id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(among.value.holds(b.column(at).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def measure_links(spark: SparkSession, pairs: DataFrame, items: DataFrame, distance: Callable, may: Callable | None, portions: int = 1) -> DataFrame:
    """(a, b, link) of ``pairs``. With ``may(sketch, sketch)``, which no link fails, only
    pairs that pass it are measured, and only payloads of their items are shuffled."""
    if may is None:
        return measure(spark, pairs, items, distance, portions).select("a", "b", "link")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("may", pa.bool_())])

    def run(batches) -> Iterator[dict]:
        for t in batches:
            yield {"a": t.column(0), "b": t.column(1), "may": [may(x, y) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist())]}

    left, right = (items.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    sketched = stored(spark, both.mapInArrow(batch_rows(run, schema), "a long, b long, may boolean"), "sketched")
    near = sketched.where("may").select("a", "b")
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    held = stored(spark, filtered(spark, items.select("id", "payload"), ids), "held")
    return measure(spark, near, held, distance, portions).select("a", "b", "link").unionByName(
        sketched.where("not may").select("a", "b", F.lit(False).alias("link")))


def _with_comp(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def open_items(spark: SparkSession, measured: DataFrame, comp: DataFrame) -> DataFrame:
    """(id): members of star regions that hold several components, and of the regions
    above and below. Two items that share a signature are in stars of two pivots at
    most, themselves in the star of one: where the items are in different components,
    one of these three regions holds several. From its pivot one step up and from
    there two steps down reach both items, and so does one step down from its members."""
    stars = measured.select(F.col("a").alias("pivot"), F.col("b").alias("id"))
    ends = _with_comp(_with_comp(stars, comp).select("pivot", F.col("comp").alias("own"), F.col("pivot").alias("id")), comp)
    mixed = stored(spark, ends.where("own <> comp").select("pivot").distinct(), "mixed")
    inside = stars.join(mixed, "pivot")
    first = inside.select("id").union(inside.select("pivot")).distinct()
    below = lambda ids: stars.join(ids.withColumnRenamed("id", "pivot"), "pivot", "left_semi").select("id")
    above = stars.join(mixed.withColumnRenamed("pivot", "id"), "id", "left_semi").select(F.col("pivot").alias("id")).distinct()
    above = stored(spark, above, "above")
    near = stored(spark, first.union(above).union(below(above)).distinct(), "near")
    return near.union(below(near)).distinct()


def _sided(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows of regions that hold several components, with their component, whether
    they are outside the region's largest one, and how many are."""
    rows = _with_comp(rows, comp)
    parts = rows.groupBy("region", "comp").agg(F.count("*").alias("n"))
    main = (parts.groupBy("region").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("size"), F.max("n").alias("most"))
            .where("size > most").select("region", "main", "size", (F.col("size") - F.col("most")).alias("outside")))
    return rows.join(main, "region").withColumn("out", F.col("comp") != F.col("main")).drop("main")


def _cut(spark: SparkSession, large: DataFrame, level: int, items: DataFrame, distance: Callable, radius: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Voronoi cells of ``large`` regions: (cells, regions that cells don't make
    smaller, links met on the way)."""
    draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30))
    drawn = large.withColumn("draw", draw)
    # every region's member of least hash, and others with a chance of PIVOTS / size
    first = drawn.groupBy("region").agg(F.min_by("id", "draw").alias("pivot"))
    more = drawn.where(F.col("draw") * F.col("size") < F.lit(float(PIVOTS << 30))).select("region", F.col("id").alias("pivot"))
    spread = large.drop("d", "comp", "size", "out", "outside").join(first.unionByName(more).distinct(), "region").withColumns(
        {"a": F.least("id", "pivot"), "b": F.greatest("id", "pivot")})
    near = measure(spark, spread.where("a <> b").select("a", "b").distinct(), items, distance)
    d = stored(spark, spread.join(near.drop("link"), ["a", "b"], "left").withColumn("d", F.coalesce("d", F.lit(0.0))).drop("a", "b"), "spread")
    nearest = d.groupBy("region", "id").agg(F.min("d").alias("least"))
    cells = d.join(nearest, ["region", "id"]).where(F.col("d") <= F.col("least") + 2 * radius + SLACK).drop("least")
    held = cells.groupBy("region").agg(F.count("*").alias("held"))
    fit = held.join(large.select("region", "size").distinct(), "region").where(F.col("held") <= OVERLAP * F.col("size")).select("region")
    inside = cells.join(fit, "region", "left_semi").withColumn("region", F.xxhash64("region", "pivot", F.lit(level))).drop("pivot")
    return inside, large.join(fit, "region", "left_anti"), near.where("link").select("a", "b")


def connect(spark: SparkSession, stars: DataFrame, items: DataFrame, distance: Callable, radius: float,
            width: float, refine: Callable[[DataFrame], DataFrame], may_link: Callable | None = None, small: int = SMALL,
            direct: int | None = None, linked: Callable | None = None, may_meet: Callable | None = None, portions: int = 1,
            may: Callable | None = None, counts: Callable | None = None, apart: float = 0) -> DataFrame:
    """Links (a, b) whose components are those of all links.

    ``stars`` (a, b): pivot and member. ``items`` (id, payload, size): ``size``
    is a coordinate in which the ends of a link differ by at most ``width``.
    ``refine(ids)`` deals open items into regions (region, id, ...) that hold all
    their links; ``may_link()`` is a condition on two rows of a region, from the
    columns that refine added (prefixed x_ and y_), which every link meets in
    some region. ``linked(payload, payload)``: a cheaper test, if distances aren't needed.
    ``direct``: regions with more members outside are compared block by block
    (None: ``may_link`` leaves few pairs, so all are compared by a join, but for
    those of more than MOST pairs, if there is ``may_meet``). ``may_meet(columns, k)``:
    ``may_link`` for arrays of the columns that refine added, between row k and all.
    ``portions``: parts in which the stars are measured. ``may(sketch, sketch)``: a test of
    the items' column ``sketch`` that every link passes; pairs that fail it aren't measured.
    ``counts(payloads)``: a row of numbers for each payload; the rows of a link's ends differ
    by at most ``apart`` in all, so blocks rule other pairs out at once.
    """
    linked = linked or (lambda x, y: distance(x, y)[0])
    measured = measure_links(spark, stars, items, distance, may, portions)
    links = measured.where("link").select("a", "b")
    comp = components(spark, links)
    ids = stored(spark, open_items(spark, measured, comp), "open")
    fine = refine(ids).join(items.select("id", F.col("size").alias("at")), "id").withColumn("d", F.lit(0.0))
    fine = stored(spark, fine, "fine")
    work, final, held = stored(spark, _sided(fine, comp), "work"), [], None
    for level in range(LEVELS):
        large = work.where(F.col("outside") > small)
        if large.isEmpty():
            if level == 0:
                held = work  # nothing is cut, so regions and components are as they were
            final.append(work)
            work = None
            break
        final.append(work.where(F.col("outside") <= small))
        inside, whole, found = _cut(spark, large, level, items, distance, radius)
        final.append(whole)
        links = links.unionByName(found)
        comp = components(spark, links)
        work = stored(spark, _sided(inside, comp), "work")
    if work is not None:
        final.append(work)
    rows = final[0]
    for part in final[1:]:
        rows = rows.unionByName(part)
    rows = rows.drop("comp", "out", "outside", "size")
    if held is None:
        held = stored(spark, _sided(rows, comp), "final")
    near = ((F.abs(F.col("x_d") - F.col("y_d")) <= radius + SLACK) & (F.abs(F.col("x_at") - F.col("y_at")) <= width + SLACK))
    if may_link is not None:
        near = near & may_link()
    pairs = F.col("outside") * F.col("size")
    few = held.where(pairs <= MOST) if may_meet else held if direct is None else held.where(F.col("outside") <= direct)
    x = few.where("out").select([F.col(c).alias(f"x_{c}") for c in held.columns])
    y = few.select([F.col(c).alias(f"y_{c}") for c in held.columns])
    close = near & ((F.col("x_region") == F.col("y_region")) & (F.col("x_comp") != F.col("y_comp"))
                    & (~F.col("y_out") | (F.col("x_id") < F.col("y_id"))))
    rest = x.join(y, close).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()
    found = measure_links(spark, rest, items, lambda x, y: (linked(x, y), 0.0), may).where("link").select("a", "b")
    links = links.unionByName(found)
    if may_meet:
        wide = held.where(pairs > MOST)
        return links if wide.isEmpty() else links.unionByName(stored(spark, _joining(wide, items, linked, radius, width, may_meet), "wide"))
    if direct is None:
        return links
    wide = _in_blocks(held.where(F.col("outside") > direct), items, linked, radius, width, BLOCK, counts, apart)
    return links.unionByName(stored(spark, wide, "wide"))


def _joining(held: DataFrame, items: DataFrame, linked: Callable, radius: float, width: float, may_meet: Callable) -> DataFrame:
    """(a, b): links of large regions, as few as join what they join. Every two blocks of
    a region meet in a group of their own, where members of components that are
    joined already aren't compared. Regions of the same members are one."""
    added = [c for c in held.columns if c not in ("region", "id", "d", "at", "comp", "out", "outside", "size")]
    shape = held.groupBy("region").agg(F.sum(F.xxhash64("id", "d", *added).cast("decimal(38,0)")).alias("shape"), F.count("*").alias("n"))
    once = shape.groupBy("shape", "n").agg(F.min("region").alias("region")).select("region")
    blocks = F.ceil(F.col("size") / WIDE_BLOCK)
    rows = held.join(once, "region", "left_semi").select("region", "id", "d", "at", "comp", "out", *added, blocks.alias("blocks"), F.pmod(F.xxhash64("id"), blocks).alias("own"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(items.select("id", "payload"), "id")

    def meet(t: pa.Table) -> pa.Table:
        columns = {c: t[c].to_numpy() for c in added}
        ids, d, at, comp, out, own = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "d", "at", "comp", "out", "own"))
        load, apart, pairs = t["payload"], t["lo"][0] != t["hi"][0], []
        comp = comp.copy()
        for k in np.flatnonzero(out).tolist():
            near = ((comp != comp[k]) & (~out | (ids > ids[k])) & (np.abs(d - d[k]) <= radius + SLACK) & (np.abs(at - at[k]) <= width + SLACK))
            if apart:
                near &= own != own[k]  # pairs inside a block meet in that block's own group
            near &= may_meet(columns, k)
            mine = load[k].as_py()
            for j in np.flatnonzero(near).tolist():
                if comp[j] != comp[k] and linked(mine, load[j].as_py()):
                    pairs.append((ids[k], ids[j]))
                    comp[comp == comp[j]] = comp[k]
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    grouped = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).groupBy("region", "lo", "hi")
    return grouped.applyInArrow(meet, "a long, b long").distinct()


def _in_blocks(held: DataFrame, items: DataFrame, linked: Callable, radius: float, width: float, block: int,
               counts: Callable | None = None, apart: float = 0) -> DataFrame:
    """Links in large regions: outside members and all members are dealt into blocks, and
    every two blocks meet in a group of their own, which returns links only. So a member is
    copied once for each block of outside members, however many are inside."""
    rows = held.select("region", "id", "d", "at", "comp", "out", F.ceil(F.col("outside") / block).alias("outer"), F.ceil(F.col("size") / block).alias("whole"))
    dealt = lambda c: F.pmod(F.xxhash64("id"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.where("out").withColumns({"x": dealt("outer"), "left": F.lit(True)}).withColumn("y", every("whole"))
    right = rows.withColumns({"y": dealt("whole"), "left": F.lit(False)}).withColumn("x", every("outer"))

    def meet(t: pa.Table) -> pa.Table:
        ids, d, at, comp, out, left, load = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "d", "at", "comp", "out", "left", "payload"))
        seen = counts(load) if counts else None
        mine, others, a, b = np.flatnonzero(left), np.flatnonzero(~left), [], []
        for k in mine.tolist():
            near = others[(comp[others] != comp[k]) & (~out[others] | (ids[others] > ids[k])) & (np.abs(d[others] - d[k]) <= radius + SLACK)
                          & (np.abs(at[others] - at[k]) <= width + SLACK)]
            if seen is not None and len(near):
                near = near[np.abs(seen[near] - seen[k]).sum(axis=1) <= apart]
            for j in near.tolist():
                if linked(load[k], load[j]):
                    a.append(min(ids[k], ids[j]))
                    b.append(max(ids[k], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = left.unionByName(right).drop("outer", "whole").join(items.select("id", "payload"), "id")
    grouped = both.groupBy("region", "x", "y")
    return grouped.applyInArrow(meet, "a long, b long").distinct()
