"""Page layout: lines, rows and columns, overlap, duplicates, votes between OCR engines, words of elements.

Folds that depend on order run over one page's boxes as an array: a page fits a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bounds, iou, quad_percent
from ..functions.text import BLANK, element_text, strip

BOX = ("x", "y", "w", "h")


def confident(regions: DataFrame, least: float = 0.6) -> DataFrame:
    return regions.where(F.col("confidence") >= least)


def cell_sized(boxes: DataFrame, page_width: Column, page_height: Column) -> DataFrame:
    """Boxes that may be table cells: not tiny, not the page."""
    return boxes.where((F.col("w") >= 20) & (F.col("h") >= 15) & (F.col("w") < 0.95 * page_width) & (F.col("h") < 0.95 * page_height))


def reading_order(regions: DataFrame) -> DataFrame:
    return regions.orderBy("doc_id", "y", "x", "pos")


def lines(regions: DataFrame, gap: int = 20) -> DataFrame:
    """doc_id, text: regions in order of pos; a new line where y is more than gap from the one before; in a line by x."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    jump = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > gap, F.lit(True))
    x = regions.withColumn("line", F.sum(jump.cast("int")).over(order))
    by = x.groupBy("doc_id", "line").agg(F.array_sort(F.collect_list(F.struct("x", "pos", "text"))).alias("r"))
    by = by.select("doc_id", "line", F.array_join(F.transform("r", lambda r: r["text"]), " ").alias("text"))
    whole = by.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    return whole.select("doc_id", F.array_join(F.transform("l", lambda v: v["text"]), "\n").alias("text"))


def region_text(regions: DataFrame) -> DataFrame:
    """doc_id, text, confidence: texts in order and their mean confidence, 0 of none."""
    by = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    return by.select("doc_id", F.array_join(F.transform("r", lambda v: v["text"]), " ").alias("text"), "confidence")


def cluster(values: Column, tolerance: float = 10) -> Column:
    """array of struct(v, no) of distinct values in order: a value joins the cluster if it is within the tolerance of the cluster's first."""
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("no"), F.array().cast("array<struct<v: double, no: int>>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        new = acc["anchor"].isNull() | (v - acc["anchor"] >= tolerance)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(F.when(new, v).otherwise(acc["anchor"]).alias("anchor"), no.alias("no"), F.array_append(acc["out"], F.struct(v.alias("v"), no.alias("no"))).alias("out"))

    return F.aggregate(F.array_sort(F.array_distinct(F.transform(values, lambda v: v.cast("double")))), start, step, lambda acc: acc["out"])


def grid(cells: DataFrame, tolerance: float = 10) -> DataFrame:
    """cells with row_no and col_no."""
    by = cells.groupBy("doc_id").agg(cluster(F.collect_set("y"), tolerance).alias("rows"), cluster(F.collect_set("x"), tolerance).alias("cols"))
    place = lambda clusters, v: F.filter(clusters, lambda c: c["v"] == v.cast("double"))[0]["no"]
    return cells.join(by, "doc_id").withColumns({"row_no": place(F.col("rows"), F.col("y")), "col_no": place(F.col("cols"), F.col("x"))}).drop("rows", "cols")


def _kept(regions: Column, same: float) -> Column:
    none = F.slice(regions, 1, 0)
    return F.aggregate(regions, none, lambda acc, r: F.when(F.exists(acc, lambda k: iou(k, r) > same), acc).otherwise(F.array_append(acc, r)))


def without_overlaps(regions: DataFrame, same: float = 0.5) -> DataFrame:
    """Regions without those that overlap a kept one of the same page by more than same; the more confident first, earlier ones on ties."""
    rest = [c for c in regions.columns if c != "doc_id"]
    by = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("_c"), F.col("pos").alias("_p"), *rest))).alias("r"))
    return by.select("doc_id", F.explode(_kept(F.col("r"), same)).alias("k")).select("doc_id", *(F.col(f"k.{c}").alias(c) for c in rest))


def merged_without_overlaps(*engines: DataFrame, same: float = 0.5) -> DataFrame:
    """The union of engines' regions, without overlaps."""
    out = engines[0]
    for e in engines[1:]:
        out = out.unionByName(e)
    return without_overlaps(out, same)


def tagged(**engines: DataFrame) -> DataFrame:
    """Regions of several engines in one table, in the order given."""
    parts = [e.withColumn("engine", F.lit(name)).withColumn("engine_no", F.lit(i)) for i, (name, e) in enumerate(engines.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leader_groups(regions: DataFrame, same: float = 0.5) -> DataFrame:
    """regions with leader: the pos of the first region that leads one's group.

    In order of pos, a region joins the first leader that it overlaps by more than same, else it leads.
    """
    rest = [c for c in regions.columns if c != "doc_id"]
    by = regions.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("_p"), *rest))).alias("r"))
    by = by.withColumn("leaders", _kept(F.col("r"), same))
    one = by.select("doc_id", "leaders", F.explode("r").alias("k"))
    lead = F.filter("leaders", lambda v: (v["_p"] == F.col("k._p")) | (iou(v, F.col("k")) > same))
    is_leader = F.exists("leaders", lambda v: v["_p"] == F.col("k._p"))
    return one.select("doc_id", *(F.col(f"k.{c}").alias(c) for c in rest), F.when(is_leader, F.col("k._p")).otherwise(lead[0]["_p"]).alias("leader"))


def vote(regions: DataFrame, strategy: str = "confidence_weighted", same: float = 0.5) -> DataFrame:
    """One region of each group of overlapping ones.

    majority: the commonest text (first seen on ties), its most confident region. confidence_weighted: the text of the
    greatest summed confidence, its first region. trocr_priority: the first of trocr, else the most confident.
    """
    return votes(regions, (strategy,), same).drop("strategy")


def votes(regions: DataFrame, strategies: tuple[str, ...], same: float = 0.5) -> DataFrame:
    """vote() of several strategies, a column more; the groups, which cost most, are found once."""
    x = leader_groups(regions, same)
    columns = x.columns
    group, text = Window.partitionBy("doc_id", "leader"), Window.partitionBy("doc_id", "leader", "text")
    trocr = F.col("engine") == "trocr"
    added, orders = {}, {}
    for strategy in strategies:
        if strategy == "majority":
            added |= {"_first": F.min("pos").over(text), "_count": F.count("*").over(text).cast("double")}
            orders[strategy] = [F.desc("_count"), F.asc("_first"), F.desc("confidence"), F.asc("pos")]
        elif strategy == "confidence_weighted":
            added |= {"_first": F.min("pos").over(text), "_sum": F.round(F.sum("confidence").over(text), 9)}
            orders[strategy] = [F.desc("_sum"), F.asc("_first"), F.asc("pos")]
        elif strategy == "trocr_priority":
            orders[strategy] = [F.desc(trocr.cast("double")), F.when(trocr, F.col("pos")).asc_nulls_last(), F.desc("confidence"), F.asc("pos")]
        else:
            raise ValueError(strategy)
    x = x.withColumns(added) if added else x
    for i, order in enumerate(orders.values()):
        x = x.withColumn(f"_rank{i}", F.row_number().over(group.orderBy(*order)))
    won = F.array_compact(F.array(*(F.when(F.col(f"_rank{i}") == 1, s) for i, s in enumerate(orders))))
    return x.select(*columns, F.explode(won).alias("strategy"))


#: Candidate pairs that are compared at once, and the boxes of one place, or pairs of places, of a row.
PAIRS, PLACE = 1_000_000, 1000


def _overlaps(least: float):
    """Of rows (doc_id, strip, upper, pos, x, y, w, h) sorted by doc_id and strip, rows (doc_id, a, b, same, iou).

    a and b are the pos of boxes in two places that overlap by more than least, all of a with all of b; or, if same, of one place.
    """
    import numpy as np
    import pyarrow as pa

    def lists(pos, start, end):
        """An array of the runs start to end of pos."""
        many = end - start
        at = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pos.take(pa.array(at)))

    def places(box, start):
        """Runs of equal boxes: those that start at start, cut to PLACE, and the box of each."""
        many = -(-np.diff(start) // PLACE)
        part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        first = np.repeat(start[:-1], many) + part * PLACE
        return first, np.minimum(first + PLACE, np.repeat(start[1:], many)), [v[first] for v in box]

    def group(doc, upper, pos, box):
        order = np.lexsort((*box[::-1], upper))
        upper, box, pos = upper[order], [v[order] for v in box], pos.take(pa.array(order))
        cut = int(np.searchsorted(upper, 1))
        sides = []
        for lo, hi in ((0, cut), (cut, len(upper))):
            own = [v[lo:hi] for v in box]
            new = np.zeros(hi - lo, bool)
            new[:1] = True
            for v in own:
                new[1:] |= v[1:] != v[:-1]
            sides.append(places(own, np.append(np.flatnonzero(new), hi - lo)))
        (l0, l1, low), (u0, u1, up) = sides
        u0, u1 = u0 + cut, u1 + cut
        if not len(l0) or not len(u0):
            return
        # the lower box's x lies within what overlaps by more than least leave: places are in order of x
        reach = np.minimum(up[2] / least, low[2].max())
        lo, hi = np.searchsorted(low[0], up[0] - (1 - least) * reach, "left"), np.searchsorted(low[0], up[0] + (1 - least) * up[2], "right")
        ends = np.cumsum(np.maximum(hi - lo, 0))
        first = 0
        while first < len(u0):
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            many = np.maximum(hi[first:last] - lo[first:last], 0)
            i = np.repeat(np.arange(first, last), many)
            j = np.repeat(lo[first:last], many) + np.arange(len(i)) - np.repeat(ends[first:last] - many - done, many)
            first = last
            # of two boxes, the upper one has the lesser y, and of equal ones the lesser x, w, h
            down = low[1][j] - up[1][i]
            ok = (down >= 0) & (down <= (1 - least) * up[3][i])
            i, j, down = i[ok], j[ok], down[ok]
            level, before = np.flatnonzero(down == 0), np.zeros(len(i), bool)
            before[down > 0] = True
            open_ = np.ones(len(level), bool)
            for k in (0, 2, 3):
                p, q = up[k][i[level]], low[k][j[level]]
                before[level] |= open_ & (p < q)
                open_ &= p == q
            same = np.zeros(len(i), bool)
            same[level] = open_
            ok = before | same
            i, j, same = i[ok], j[ok], same[ok]
            p, q = [v[i] for v in up], [v[j] for v in low]
            wide, high = (np.minimum(p[k] + p[k + 2], q[k] + q[k + 2]) - np.maximum(p[k], q[k]) for k in (0, 1))
            both = (wide * high).astype(float)
            area = p[2] * p[3] + q[2] * q[3]
            ok = np.flatnonzero((wide > 0) & (high > 0) & (both * (1 + least) > least * area))
            i, j, same, iou = i[ok], j[ok], same[ok], both[ok] / (area[ok] - both[ok])
            size = np.cumsum(u1[i] - u0[i] + l1[j] - l0[j])
            at = 0
            while at < len(i):
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS // 4, "right")))
                x, y = i[at:end], j[at:end]
                columns = [pa.array([doc]).take(pa.array(np.zeros(end - at, np.int64))) if doc is not None else pa.nulls(end - at), lists(pos, u0[x], u1[x]), lists(pos, l0[y], l1[y]), pa.array(same[at:end]), pa.array(iou[at:end])]
                yield columns
                at = end

    def run(batches):
        held = []

        def whole(table):
            table = table.combine_chunks()
            doc, strip = table["doc_id"].combine_chunks(), table["strip"].to_numpy()
            codes = doc.dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (codes[1:] != codes[:-1]) | (strip[1:] != strip[:-1])]))
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(strip)]):
                part = table.slice(lo, hi - lo)
                box = [part[c].to_numpy() for c in BOX]
                for columns in group(doc[lo].as_py(), part["upper"].to_numpy(), part["pos"].combine_chunks(), box):
                    columns[0] = columns[0].cast(doc.type)
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "same", "iou"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(pa.Table.from_batches([b]))
            key = lambda t, k: (t["doc_id"][k], t["strip"][k])
            if key(held[0], 0) != key(held[-1], -1):  # all but the last strip is whole
                x = pa.concat_tables(held).combine_chunks()
                doc, strip = x["doc_id"].combine_chunks().dictionary_encode().indices.to_numpy(), x["strip"].to_numpy()
                cut = int(np.flatnonzero((doc != doc[-1]) | (strip != strip[-1]))[-1]) + 1
                yield from whole(x.slice(0, cut))
                held = [x.slice(cut)]
        if held:
            yield from whole(pa.concat_tables(held))

    return run


def overlapping_pairs(boxes: DataFrame, least: float = 0.5, cell: int = 64, places: int | None = None) -> DataFrame:
    """doc_id, a, b, iou: pairs of boxes of a page that overlap by more than least; joined by the strips, of half a cell's height, that they touch.

    A pair is found once: in the strip where the lower box begins, with the upper ones whose tops reach it. In a strip, boxes
    are compared in windows of x, and boxes of one place once for all; only then are they paired one by one. Boxes of such an overlap
    are alike in size: a side and the shift along it are bounded by the other's. cell should be about the boxes' size.
    iou is rounded to that many places, before boxes of one place are told apart.
    """
    kinds = dict(boxes.dtypes)
    number = "bigint" if all(kinds[c] in ("tinyint", "smallint", "int", "bigint") for c in BOX) else "double"
    x = boxes.select("doc_id", "pos", *(F.col(c).cast(number).alias(c) for c in BOX)).where("doc_id is not null and pos is not null and w > 0 and h > 0")
    if number == "double":
        x = x.where(" and ".join(f"abs({c}) < double('infinity')" for c in BOX))
    strip = lambda y: F.floor(y * 2 / cell)
    own = x.withColumns({"strip": strip(F.col("y")), "upper": F.lit(0)})
    over = x.withColumns({"strip": F.explode(F.sequence(strip(F.col("y")), strip(F.col("y") + (1 - least) * F.col("h")))), "upper": F.lit(1)})
    rows = own.unionByName(over).select("doc_id", "strip", "upper", "pos", *BOX)
    parts = 8 * boxes.sparkSession.sparkContext.defaultParallelism
    met = rows.repartition(parts, "doc_id", "strip").sortWithinPartitions("doc_id", "strip")
    found = met.mapInArrow(_overlaps(least), f"doc_id {kinds['doc_id']}, a array<{kinds['pos']}>, b array<{kinds['pos']}>, same boolean, iou double")
    if places is not None:
        found = found.withColumn("iou", F.round("iou", places))
    each = found.select("doc_id", F.explode("a").alias("a"), "b", "same", "iou").select("doc_id", "a", F.explode("b").alias("b"), "same", "iou")
    each = each.where("a <> b and (a < b or not same)")
    return each.select("doc_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "iou")


def engine_report(regions: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """engine, boxes, confidence, and with truth(doc_id, truth) the mean character accuracy of pages."""
    from ..functions.similarity import character_accuracy

    out = regions.groupBy("engine").agg(F.count("*").alias("boxes"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    if truth is None:
        return out
    by = regions.groupBy("engine", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("r"))
    by = by.select("engine", "doc_id", F.array_join(F.transform("r", lambda v: v["text"]), " ").alias("text")).join(truth, "doc_id")
    return out.join(by.select("engine", character_accuracy(F.col("text"), F.col("truth")).alias("a")).groupBy("engine").agg(F.avg("a").alias("accuracy")), "engine", "left")


def ocr_words(pages: DataFrame) -> DataFrame:
    """doc_id, page, pos, text, confidence, x, y, width, height in percent of the page, and px_ in whole pixels.

    Blank words and boxes of less than four points are dropped.
    """
    one = pages.select("doc_id", F.posexplode("pages").alias("page", "p")).select("doc_id", "page", "p.width", "p.height", F.posexplode("p.words").alias("pos", "w"))
    one = one.withColumn("text", strip(F.col("w.text"))).where("text <> ''").where(F.size("w.boundingBox.vertices") >= 4).withColumn("b", bounds(F.col("w.boundingBox.vertices")))
    pct = lambda part, whole: F.bround(F.col(f"b.{part}") / F.col(whole) * 100, 2)
    px = lambda part: F.col(f"b.{part}").cast("int")
    return one.select(
        "doc_id", "page", "pos", "text", F.coalesce("w.confidence", F.lit(1.0)).alias("confidence"),
        pct("x", "width").alias("x"), pct("y", "height").alias("y"), pct("w", "width").alias("width"), pct("h", "height").alias("height"),
        px("x").alias("px_x"), px("y").alias("px_y"), px("w").alias("px_width"), px("h").alias("px_height"),
    )


def _elements(elements: DataFrame) -> DataFrame:
    x = elements.select("doc_id", F.posexplode("elements").alias("pos", "e"))
    text = element_text(F.col("e.content.text"), F.col("e.content.markdown"))
    return x.select("doc_id", "pos", F.coalesce("e.category", F.lit("paragraph")).alias("category"), text.alias("text"), quad_percent(F.coalesce("e.coordinates", F.array())).alias("q"))


def element_blocks(elements: DataFrame) -> DataFrame:
    """doc_id, pos, category, text, x, y, width, height of elements that have text."""
    pct = lambda c: F.bround(F.col(f"q.{c}"), 2)
    return _elements(elements).where("text <> ''").select("doc_id", "pos", "category", "text", pct("x").alias("x"), pct("y").alias("y"), pct("w").alias("width"), pct("h").alias("height"))


def element_words(elements: DataFrame) -> DataFrame:
    """doc_id, pos, word_no, text, x, y, width, height: an element's width shared by its words' lengths, a little gap taken off each."""
    x = _elements(elements).where("text <> ''").where("q.w > 0")
    x = x.withColumn("words", F.filter(F.split("text", f"[{BLANK}]+"), lambda w: w != ""))
    x = x.withColumn("chars", F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w))).select("*", F.posexplode("words").alias("word_no", "word"))
    order = Window.partitionBy("doc_id", "pos").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("own", F.col("q.w") * F.length("word") / F.col("chars"))
    left = F.col("q.x") + F.coalesce(F.sum("own").over(order), F.lit(0.0))
    gap = F.when(F.size("words") > 1, F.col("q.w") * 0.02).otherwise(0.0)
    return x.select(
        "doc_id", "pos", "word_no", F.col("word").alias("text"), F.bround(left, 2).alias("x"), F.bround("q.y", 2).alias("y"),
        F.bround(F.greatest(F.col("own") - gap, F.lit(0.1)), 2).alias("width"), F.bround("q.h", 2).alias("height"),
    )
