"""Hard negatives from an STR-packed R-tree over integer vectors.

Packing is sort-tile-recursive: labels are cut into slabs at approximate quantiles, each slab by
the vectors' widest coordinate, each of these by the next; a tile with more rows than a page (many
equal vectors) is split by row number. A page is packed the same way into leaves, and every leaf
and page has a minimum bounding box over label and coordinates. A box bounds the inner product of
a query with all its rows: each coordinate contributes an interval, the sum of the lower ends and
of the upper ends bounds the score.

Pages and queries are dealt to a grid of cells of bounded size, one side's groups replicated along
the other side. In a cell each query keeps a queue of boxes, best upper bound first. A box is
passed over if its labels can't fit, if its interval lies outside every score window, or if its
upper end is strictly below the k-th best score so far; equal scores stay, since ties go to the
smaller id. The first search begins with the k-th best score within the query's own page.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import lookup
from ..session import materialise

PAGE = 2048
LEAF = 256
CELL_PAGES = 4
CELL_QUERIES = 1024
# vectors from which the widest coordinates are chosen; any choice gives the same rows
SAMPLE = 4096
LONG = 1 << 63
EXACT = 1 << 53

PAGE_SCHEMA = "page long, size int, rows array<long>, ids array<long>, labels array<long>, vectors binary"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double; null if a component is null or not finite."""
    d = vector.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(d, lambda x: F.floor(x * scale)))


def str_order(keys: list[np.ndarray], size: int) -> np.ndarray:
    """Row numbers in sort-tile-recursive order: slabs by the first key, then by the next within each."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable")
    leaves = -(-n // size)
    if len(keys) == 1 or leaves < 2:
        return order
    slabs = min(leaves, int(np.ceil(leaves ** (1 / len(keys)))))
    width = -(-(-(-n // slabs)) // size) * size
    parts = [order[at : at + width] for at in range(0, n, width)]
    return np.concatenate([p[str_order([k[p] for k in keys[1:]], size)] for p in parts])


def _slabs(rows: DataFrame, keys: list[str], value: Column, n: int, name: str) -> DataFrame:
    """Adds ``name``, the slab of ``value`` between ``n`` approximate quantiles per ``keys``."""
    if n < 2:
        return rows.withColumn(name, F.lit(0))
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(value, [i / n for i in range(1, n)]).alias("_cuts"))
    if keys:
        rows = lookup(rows, cuts, keys, "inner")
    else:
        found = cuts.first()["_cuts"] or []
        rows = rows.withColumn("_cuts", F.array(*[F.lit(c) for c in found]) if found else F.array().cast("array<long>"))
    return rows.withColumn(name, F.size(F.filter("_cuts", lambda c: c < value))).drop("_cuts")


def pack(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Pages of rows (row, vec_id, label, q) and the largest number of components."""
    sample = [r.q for r in vectors.select("q").limit(SAMPLE).collect()]
    dims = int(vectors.agg(F.max(F.size("q"))).first()[0] or 0)
    grid = np.zeros((len(sample), dims))
    for i, q in enumerate(sample):
        grid[i, : len(q)] = q
    widest = np.argsort(-grid.var(axis=0), kind="stable")[:2].tolist() if len(sample) and dims else []
    n = vectors.count()
    slabs = max(1, int(np.ceil((-(-n // PAGE)) ** (1 / (1 + len(widest))))))
    rows = _slabs(vectors, [], F.col("label"), slabs, "_t0")
    tile = ["_t0"]
    for i, c in enumerate(widest, 1):
        value = F.coalesce(F.get("q", F.lit(c)), F.lit(0).cast("long"))
        rows = _slabs(rows, tile, value, slabs, f"_t{i}")
        tile = [*tile, f"_t{i}"]
    counts = rows.groupBy(*tile).agg(F.count(F.lit(1)).alias("_n"))
    rows = lookup(rows, counts, tile, "inner")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("row"), F.ceil(F.col("_n") / PAGE)))

    def build(b: pd.DataFrame) -> pd.DataFrame:
        q = np.zeros((len(b), dims), dtype=np.int64)
        for i, v in enumerate(b["q"]):
            q[i, : len(v)] = v
        label = b["label"].to_numpy()
        order = str_order([label, *[q[:, c] for c in widest]], LEAF)
        b, q = b.iloc[order], q[order]
        page = [int(b["row"].min()), len(b), b["row"].tolist(), b["vec_id"].tolist(), b["label"].tolist(), q.tobytes()]
        return pd.DataFrame([page], columns=[c.split()[0] for c in PAGE_SCHEMA.split(", ")])

    rows = rows.select(*tile, "_part", "row", "vec_id", "label", "q")
    return materialise(rows.groupBy(*tile, "_part").applyInPandas(build, PAGE_SCHEMA), "pages"), dims


class Page:
    """A page with the boxes of its leaves and its own."""

    def __init__(self, page, dims: int):
        self.rows, self.ids, self.labels = (np.asarray(x, dtype=np.int64) for x in (page.rows, page.ids, page.labels))
        self.q = np.frombuffer(page.vectors, dtype=np.int64).reshape(page.size, dims)
        self.heads = np.arange(0, page.size, LEAF)
        self.low, self.high = (f.reduceat(self.q, self.heads) for f in (np.minimum, np.maximum))
        self.label_low, self.label_high = (f.reduceat(self.labels, self.heads) for f in (np.minimum, np.maximum))


def intervals(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries with the rows of boxes."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Best:
    """The best ``k`` scores within a window, ties to the smaller id."""

    def __init__(self, k: int, low: int | None = None, high: int | None = None, floor: int | None = None):
        self.k, self.low, self.high, self.floor = k, low, high, floor
        self.found: list[tuple[int, int, int]] = []

    def least(self) -> int | None:
        """A score below this can't be among the best any more; None if any can."""
        own = -self.found[-1][0] if len(self.found) == self.k else None
        known = [x for x in (own, self.low, self.floor) if x is not None]
        return max(known) if known else None

    def passes(self, lower: int, upper: int) -> bool:
        """Whether a box with these bounds may hold one of the best."""
        least = self.least()
        return (self.high is None or lower <= self.high) and (least is None or upper >= least)

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fits = np.ones(len(scores), dtype=bool)
        if self.high is not None:
            fits &= scores <= self.high
        if (least := self.least()) is not None:
            fits &= scores >= least
        at = np.nonzero(fits)[0]
        if len(at):
            at = at[np.lexsort((rows[at], ids[at], -scores[at]))[: self.k]]
            new = [(-int(scores[i]), int(ids[i]), int(rows[i])) for i in at]
            self.found = sorted([*self.found, *new])[: self.k]


def search(pages: list[Page], queries: np.ndarray, rows: list[int], labels: list[int], same: bool, best: list[list[Best]]) -> None:
    """Fills each query's ``best`` from the pages, rows of its own label or of others; never its own row."""
    if not pages or not len(queries):
        return
    q = np.concatenate([p.q for p in pages])
    largest = max(int(np.abs(x).max(initial=0)) for x in (q.astype(object) if q.size and q.min() == -LONG else q, queries))
    exact = q.shape[1] * largest * largest < EXACT
    kind = np.float64 if exact else object  # doubles hold these products exactly, else Python's integers do
    low = np.concatenate([p.low for p in pages]).astype(kind)
    high = np.concatenate([p.high for p in pages]).astype(kind)
    label_low, label_high = (np.concatenate([getattr(p, c) for p in pages]) for c in ("label_low", "label_high"))
    heads = np.cumsum([0, *[len(p.rows) for p in pages]])
    starts = np.concatenate([p.heads + h for p, h in zip(pages, heads[:-1], strict=True)])
    ends = np.append(starts[1:], heads[-1])
    first = np.cumsum([0, *[len(p.heads) for p in pages]])
    ids, own_rows, all_labels = (np.concatenate([getattr(p, c) for p in pages]) for c in ("ids", "rows", "labels"))
    q, queries = q.astype(kind), queries.astype(kind)
    page_low = np.array([low[a:b].min(0) for a, b in zip(first[:-1], first[1:], strict=True)])
    page_high = np.array([high[a:b].max(0) for a, b in zip(first[:-1], first[1:], strict=True)])
    page_bounds, leaf_bounds = intervals(queries, page_low, page_high), intervals(queries, low, high)

    def fits(label: int, a: int, b: int) -> bool:
        lo, hi = label_low[a:b].min(), label_high[a:b].max()
        return lo <= label <= hi if same else not (lo == label == hi)

    for k, wanted in enumerate(best):
        if not wanted:
            continue
        query, row, label = queries[k], rows[k], labels[k]
        queue: list[tuple[int, int, int]] = []

        def offer(lower, upper, level: int, i: int) -> None:
            if any(w.passes(lower, upper) for w in wanted):
                heapq.heappush(queue, (-upper, level, i))

        for i in range(len(pages)):
            if fits(label, first[i], first[i + 1]):
                offer(page_bounds[0][k, i], page_bounds[1][k, i], 0, i)
        while queue:
            negative, level, i = heapq.heappop(queue)
            if level == 0:
                for leaf in range(first[i], first[i + 1]):
                    if fits(label, leaf, leaf + 1):
                        offer(leaf_bounds[0][k, leaf], leaf_bounds[1][k, leaf], 1, leaf)
            elif any(w.passes(leaf_bounds[0][k, i], -negative) for w in wanted):
                part = slice(starts[i], ends[i])
                scores = q[part] @ query
                own = all_labels[part] == label if same else all_labels[part] != label
                floors = [w.least() for w in wanted]
                may = own & (own_rows[part] != row)
                if None not in floors:
                    may &= scores >= min(floors)
                may = np.nonzero(may)[0]
                if len(may):
                    for w in wanted:
                        w.add(scores[may], ids[part][may], own_rows[part][may])


def _held(value: int) -> int:
    return max(-LONG, min(LONG - 1, value))


def _cells(pages: DataFrame, queries: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Runs ``run`` on every pair of a group of pages and a group of queries."""
    n_pages, n_queries = pages.count(), queries.count()
    columns = max(1, -(-n_pages // CELL_PAGES))
    lines = max(1, -(-n_queries // CELL_QUERIES))

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    pages = pages.withColumn("_column", F.pmod(F.xxhash64("page"), F.lit(columns)).cast("int"))
    queries = queries.withColumn("_line", F.pmod(F.xxhash64("row"), F.lit(lines)).cast("int"))
    pages = pages.withColumn("_line", all_of(lines)).groupBy("_line", "_column")
    queries = queries.withColumn("_column", all_of(columns)).groupBy("_line", "_column")
    return pages.cogroup(queries).applyInPandas(run, schema)


def _padded(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """Hard negatives of every anchor's nearest rows of its label.

    ``vectors``: vec_id, label, q (array of integers). Each row for which ``is_anchor`` holds is an
    anchor; its positives are the ``positives`` other rows of its label with the highest inner
    products, and for each of them the first ``negatives`` rows of other labels are returned whose
    score lies between ``low`` and ``high`` percent of the positive's. Higher scores come first,
    ties by smaller vec_id. Columns anchor_id, positive_id, rank (from 1), negative_id,
    positive_score, negative_score.

    Rows with a null vec_id, label or vector, or a null component, take no part. Of rows that
    repeat a vec_id each is a row of its own (an anchor can be its namesake's positive). Shorter
    vectors count as if zeros followed. Scores are exact; one beyond 64 bits is returned as the
    nearest long. Other columns are ignored; no rows give no rows.
    """
    whole = F.col("q").isNotNull() & ~F.exists("q", lambda x: x.isNull())
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("q").cast("array<long>"), is_anchor.alias("anchor")
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    pages, dims = pack(rows.drop("anchor"))
    anchors = rows.where("anchor").select("row", "vec_id", "label", "q")

    def own_page(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The k-th best score that an anchor finds in its own page."""
        for b in batches:
            for p in b.itertuples():
                page = Page(p, dims)
                at = np.nonzero(np.asarray(p.anchors, dtype=bool))[0]
                best = [[Best(positives)] for _ in at]
                search([page], page.q[at], page.rows[at].tolist(), page.labels[at].tolist(), True, best)
                full = [(int(page.rows[i]), w.least()) for i, (w,) in zip(at, best, strict=True)]
                full = [(r, min(f, LONG - 1)) for r, f in full if f is not None and f > -LONG]
                yield pd.DataFrame(full, columns=["row", "floor"])

    # marks travel with the pages: the anchors among a page's rows
    marks = pages.select("page", F.posexplode("rows").alias("at", "row"))
    marks = lookup(marks, anchors.select("row", F.lit(True).alias("yes")), ["row"], "left")
    marks = marks.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("yes", F.lit(False)).alias("yes")))).alias("m"))
    seeded = pages.join(marks.select("page", F.transform("m", lambda m: m["yes"]).alias("anchors")), "page")
    floors = seeded.where(F.exists("anchors", lambda a: a)).mapInPandas(own_page, "row long, floor long")
    floors = materialise(floors, "floors")
    asked = lookup(anchors, floors, ["row"], "left")
    # the least long stands for no floor
    asked = materialise(asked.withColumn("floor", F.coalesce("floor", F.lit(-LONG))), "anchors")

    def nearest(p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        best = [[Best(positives, floor=None if f == -LONG else f)] for f in a["floor"].tolist()]
        own = a["row"].tolist()
        search([Page(x, dims) for x in p.itertuples()], _padded(a["q"], dims), own, a["label"].tolist(), True, best)
        out = [(r, i, o, _held(-s)) for r, (w,) in zip(own, best, strict=True) for s, i, o in w.found]
        return pd.DataFrame(out, columns=["row", "positive_id", "other", "score"])

    found = _cells(pages, asked, nearest, "row long, positive_id long, other long, score long")
    first = Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "other")
    found = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "score"))).alias("p"))
    found = found.select("row", F.transform("p", lambda p: p["positive_id"]).alias("positive_ids"), F.transform("p", lambda p: p["score"]).alias("scores"))
    asked = materialise(lookup(anchors, found, ["row"], "inner"), "positives")

    def between(p: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        own, best, named = a["row"].tolist(), [], []
        for scores in a["scores"]:
            spans = [(-(-low * int(s) // 100), high * int(s) // 100) for s in scores]
            kept = [i for i, (lo, hi) in enumerate(spans) if lo <= hi]
            named.append(kept)
            best.append([Best(negatives, *spans[i]) for i in kept])
        search([Page(x, dims) for x in p.itertuples()], _padded(a["q"], dims), own, a["label"].tolist(), False, best)
        out = [
            (r, v, place + 1, int(ids[place]), int(scores[place]), i, o, _held(-s))
            for r, v, ids, scores, kept, ws in zip(own, a["vec_id"], a["positive_ids"], a["scores"], named, best, strict=True)
            for place, w in zip(kept, ws, strict=True)
            for s, i, o in w.found
        ]
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    schema = (
        "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, other long, "
        "negative_score long"
    )
    hits = _cells(pages, asked, between, schema)
    first = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id", "other")
    hits = hits.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return hits.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
