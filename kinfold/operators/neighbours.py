"""k-nearest-neighbour join: an exact way and an index, both over the same cells.

Reference rows lie in the cell of their nearest pivot; there are about as many pivots as the square
root of the rows.  Cells near each other form *regions* of ``BLOCK_ROWS`` to ``MOST_ROWS`` rows, the units that queries
travel to.

*Exact* (the default): a query first meets its own cell, which gives it a radius of its own.  It then
visits only cells whose ring of distances to their pivot that radius meets (and that are not wholly on
the far side of the half-way plane), and is compared only with the rows inside the ring.
*Index* (``probes``): a query visits its ``probes`` nearest cells, whatever its radius; ``recall`` measures what
that misses.  Vectors of many dimensions need it, since there a radius meets every ring.

No cross join, and no task holds a whole crowded region: both sides are cut into blocks.  Copies of one vector
beyond the k smallest ids can never be chosen and are dropped before the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from kinfold.plans.session import cut_lineage

BLOCK_ROWS = 1024
#: Rows of the largest blocks.
MOST_ROWS = 16384
#: Bytes of the pivots on the driver and in each task; with more rows the cells get larger instead.
PIVOT_BYTES = 1 << 25
#: Distances (times dimensions) that are worked out at once.
AT_ONCE = 1 << 22
#: Quick distances that are worked out at once (they should stay in a core's cache).
SCREENED = 1 << 17
#: Queries from which the number of probes is set.
SAMPLE_QUERIES = 256
#: Pivots from whose nearest rows a query's first radius comes.
NEAREST_PIVOTS = 4


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances by direct differences (equal vectors give exactly equal values)."""
    out = np.empty((len(a), len(b)))
    step = max(1, AT_ONCE // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.abs(d).sum(axis=2) if metric == "l1" else np.sqrt((d * d).sum(axis=2))
    return out


def _paired(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """The distances of ``a[i]`` and ``b[j]``, equal to those of ``_distances``."""
    out = np.empty(len(i))
    step = max(1, AT_ONCE // max(1, a.shape[1]))
    for lo in range(0, len(i), step):
        d = a[i[lo:lo + step]] - b[j[lo:lo + step]]
        out[lo:lo + step] = np.abs(d).sum(axis=1) if metric == "l1" else np.sqrt((d * d).sum(axis=1))
    return out


class Screen:
    """Quick distances in single precision, each with a bound of its error: what they can't rule out is
    worked out directly.  So no pair is lost, and no result depends on them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, metric: str):
        self.metric, width = metric, a.shape[1]
        centre = b.mean(axis=0)
        centre = centre if np.isfinite(centre).all() else np.zeros(width)
        size = np.abs(a).max() + np.abs(b).max() if a.size and b.size else 0.0
        self.shift = 1e-15 * width * size  # what centring can change
        kind = np.float32 if size < 1e15 else np.float64
        self.a, self.b = (np.ascontiguousarray((x - centre).T.astype(kind)) for x in (a, b))
        norm = np.square if metric == "l2" else np.abs
        self.a_size, self.b_size = (norm(x.astype(float)).sum(axis=0) for x in (self.a, self.b))
        self.eps = float(np.finfo(kind).eps) * (2 * width + 8)
        self.kind = kind
        if metric == "l2":
            self.a_rows, self.a_sq, self.b_sq = np.ascontiguousarray(self.a.T), self.a_size.astype(kind), self.b_size.astype(kind)

    def quick(self, q: np.ndarray, x: int, y: int) -> np.ndarray:
        """Distances (l1) or their squares (l2) of the rows ``q`` to x..y."""
        if self.metric == "l2":
            out = self.a_rows[q] @ self.b[:, x:y]
            out *= -2
            out += self.a_sq[q, None]
            out += self.b_sq[None, x:y]
            return out
        out, part = np.zeros((len(q), y - x), self.kind), np.empty((len(q), y - x), self.kind)
        for u, v in zip(self.a[:, q], self.b[:, x:y]):
            np.subtract(u[:, None], v[None, :], out=part)
            np.abs(part, out=part)
            out += part
        return out

    def within(self, q: np.ndarray, x: int, y: int, limit: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j) of all pairs q[i], x + j that can be no farther than ``limit[i]`` and among the ``want`` nearest."""
        s = self.quick(q, x, y)
        slack = self.eps * (self.a_size[q] + self.b_size[x:y].max()) + 1e-30
        square = self.metric == "l2"

        def top(r: np.ndarray) -> np.ndarray:
            r = r + self.shift
            return np.nextafter(((r * r if square else r) + slack).astype(self.kind), self.kind(np.inf))

        good = ~(s > top(limit)[:, None])  # what isn't a number stays
        if y - x > want and np.count_nonzero(good) > 4 * want * len(q):
            kth = np.maximum(np.partition(s, want - 1, axis=1)[:, want - 1].astype(float) + slack, 0)
            far = (np.sqrt(kth) if square else kth) + self.shift
            good = ~(s > np.fmin(top(limit), top(far))[:, None])
        return np.nonzero(good)


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(float)


def _first(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """k first rows per group of few rows (a query's finds: at most k a block)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k)


def _smallest(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """k first rows per group in two steps, so a hot group is cut before it is gathered."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(64)))
    first = Window.partitionBy(*by, "__salt").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    cut = salted.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k)
    return cut.withColumn("__r", F.row_number().over(final)).where(F.col("__r") <= k).drop("__salt")


class Cells:
    """Pivots, and what is known of the reference rows in their cells."""

    def __init__(self, pivots: np.ndarray, metric: str, regions: int):
        self.pivots, self.metric = pivots, metric
        # a region is named by one of the first pivots; with as many regions as pivots each is its own
        self.region = np.arange(len(pivots)) if regions >= len(pivots) else np.concatenate([
            _distances(pivots[i:i + 1024], pivots[:regions], metric).argmin(axis=1) for i in range(0, len(pivots), 1024)])
        self.low, self.high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        self.near = np.full((len(pivots), 1), np.inf)

    def know(self, facts: list, nearest: list, want: int) -> None:
        for r in facts:
            self.low[r["cell"]], self.high[r["cell"]] = r["low"], r["high"]
        self.near = np.full((len(self.pivots), want), np.inf)
        filled: dict[int, int] = {}
        for r in nearest:
            at = filled[r["cell"]] = filled.get(r["cell"], -1) + 1
            self.near[r["cell"], at] = r["pd"]

    def to(self, v: np.ndarray) -> np.ndarray:
        return _distances(v, self.pivots, self.metric)

    def pieces(self, frames):
        """The frames in parts whose distances to all pivots fit ``AT_ONCE``."""
        step = max(1, AT_ONCE // len(self.pivots))
        for pdf in frames:
            for lo in range(0, len(pdf), step):
                yield pdf.iloc[lo:lo + step]

    def first_radius(self, d: np.ndarray, want: int) -> np.ndarray:
        """An upper bound of the distance of each row's ``want``-th neighbour, from its nearest pivots."""
        few = min(NEAREST_PIVOTS, d.shape[1])
        at = np.argpartition(d, few - 1, axis=1)[:, :few]
        reach = (np.take_along_axis(d, at, 1)[:, :, None] + self.near[at]).reshape(len(d), -1)
        return np.partition(reach, want - 1, axis=1)[:, want - 1]

    def asked(self, d: np.ndarray, at, own: np.ndarray, radius: np.ndarray, search: str) -> np.ndarray:
        """Whether the rows visit the cells ``at``, whose pivots are ``d`` away.

        ``own``: the cells whose pivot is no farther than ``own``; else ``others``: the cells beyond ``own`` (the
        distance of the nearest pivot) in which a row nearer than ``radius`` can lie.
        """
        if search == "own":
            return d <= own[:, None]
        r = radius[:, None] + 1e-9 * (1 + d)
        ring = (d - r <= self.high[at]) & (d + r >= self.low[at])
        return ring & (d > own[:, None]) & (d - own[:, None] <= 2 * r)

    def regions_of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, region) of the asked cells, each once."""
        order = np.argsort(self.region, kind="stable")
        names, start = np.unique(self.region[order], return_index=True)
        q, g = np.nonzero(np.logical_or.reduceat(asked[:, order], start, axis=1))
        return q, names[g]


def _compared(a: pd.DataFrame, b: pd.DataFrame, query_id: str, cells: Cells, search: str, want: int, counter) -> pd.DataFrame:
    """The ``want`` nearest of ``b`` for each row of ``a``, among the cells and rings it asks for."""
    none = pd.DataFrame({query_id: [], "ref_id": [], "ref_label": [], "dist": []})
    if a.empty or b.empty:
        return none
    metric = cells.metric
    b = b.sort_values(["cell", "pd"], kind="stable")
    ref_v, ring, cell = _vectors(b["v"]), b["pd"].to_numpy(), b["cell"].to_numpy()
    ids, labels = b["ref_id"].to_numpy(), b["ref_label"].to_numpy()
    order_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    query_v, radius, own = _vectors(a["v"]), a["radius"].to_numpy(dtype=float), a["own"].to_numpy(dtype=float)
    screen = Screen(query_v, ref_v, metric)
    best = np.full((len(a), want), np.inf)  # distances of the nearest so far
    q_rows, r_rows, dists, compared = [], [], [], 0
    for c in np.unique(cell):
        lo, hi = np.searchsorted(cell, (c, c + 1))
        dq = _distances(query_v, cells.pivots[c:c + 1], metric)
        at = np.flatnonzero(cells.asked(dq, slice(c, c + 1), own, radius, search))
        dq = dq[:, 0]
        at = at[np.argsort(dq[at], kind="stable")]
        reach = radius[at] * (1 + 1e-9) + 1e-9 * (1 + dq[at])
        first, last = (lo + np.searchsorted(ring[lo:hi], x, side) for x, side in
                       ((dq[at] - reach, "left"), (dq[at] + reach, "right")))
        step = min(256, max(16, SCREENED // (hi - lo)))
        for i in range(0, len(at), step):
            part = slice(i, i + step)
            x, y = int(first[part].min()), int(last[part].max())
            q = at[part]
            for x, y in ((u, min(y, u + SCREENED)) for u in range(x, y, SCREENED)):
                limit = np.minimum(reach[part], best[q, -1])
                compared += len(q) * (y - x)
                i_, j_ = screen.within(q, x, y, limit, want)
                d = _paired(query_v, q[i_], ref_v, x + j_, metric)
                good = d <= limit[i_]
                i_, j_, d = i_[good], j_[good], d[good]
                if not len(d):
                    continue
                q_rows.append(q[i_])
                r_rows.append(j_ + x)
                dists.append(d)
                order = np.lexsort((d, i_))
                place = _places(i_[order])
                new = np.full((len(q), want), np.inf)
                new[i_[order][place < want], place[place < want]] = d[order][place < want]
                best[q] = np.sort(np.concatenate([best[q], new], axis=1), axis=1)[:, :want]
    if counter is not None:
        counter.add(compared)
    if not q_rows:
        return none
    q, r, d = np.concatenate(q_rows), np.concatenate(r_rows), np.concatenate(dists)
    stay = d <= best[q, -1]
    q, r, d = q[stay], r[stay], d[stay]
    order = np.lexsort((order_id[r], d, q))
    q, r, d = q[order], r[order], d[order]
    place = _places(q)
    q, r, d = q[place < want], r[place < want], d[place < want]
    return pd.DataFrame({query_id: a[query_id].to_numpy()[q], "ref_id": ids[r], "ref_label": labels[r], "dist": d})


def _places(q: np.ndarray) -> np.ndarray:
    """The place of each entry among its equals, which stand together."""
    new = np.append(True, q[1:] != q[:-1])
    return np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))


def _block(n: int, spark) -> int:
    """Rows of a block: larger blocks send each vector to fewer others; several pairs of blocks a task remain."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(BLOCK_ROWS, min(MOST_ROWS, int(n / (2 * tasks ** 0.5))))


def _meet(
    visits: DataFrame, query: DataFrame, placed: DataFrame, cells: Cells, query_id: str, search: str, want: int, block: int, counter,
) -> DataFrame:
    """(query_id, ref_id, ref_label, dist) for ``visits`` (query_id, region, radius, own)."""
    loads = lambda df: {r["region"]: -(-r["n"] // block) for r in  # noqa: E731  one number per region
                        df.groupBy("region").agg(F.count("*").alias("n")).collect()}
    q_blocks, s_blocks = loads(visits), loads(placed)
    spark = visits.sparkSession
    blocks = spark.createDataFrame(
        [(int(g), q_blocks[g], s_blocks[g]) for g in q_blocks if g in s_blocks], "region int, qn int, sn int")
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["region", "qb", "sb"]
    left = visits.join(F.broadcast(blocks), "region").select(
        query_id, "region", "radius", "own", deal(query_id, "qn").alias("qb"), every("sn").alias("sb"))
    left = left.join(query.select(query_id, "v"), query_id)
    right = placed.join(F.broadcast(blocks), "region").withColumn("sb", deal("ref_id", "sn")).withColumn("qb", every("qn")).drop("qn", "sn")
    schema = T.StructType([query.schema[query_id], placed.schema["ref_id"], placed.schema["ref_label"],
                           T.StructField("dist", T.DoubleType())])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda a, b: _compared(a, b, query_id, cells, search, want, counter), schema)


def _cells(ref: DataFrame, n: int, width: int, metric: str, block: int = BLOCK_ROWS) -> Cells:
    count = max(1, min(int(np.ceil(np.sqrt(n))), PIVOT_BYTES // (8 * max(1, width))))
    rows = ref.select("v").orderBy(F.xxhash64("v")).limit(count).collect()
    return Cells(np.array([r["v"] for r in rows], dtype=float), metric, -(-n // block))


def _distinct_refs(ref: DataFrame, vec: str, want: int) -> DataFrame:
    ref = ref.select("ref_id", F.col(vec).alias("v"), "ref_label").where("v is not null")
    return _smallest(ref, ["v"], ["ref_id"], want).drop("__r")


def probes_for(
    query: DataFrame, ref: DataFrame, query_id: str, vec: str, k: int, metric: str = "l2",
    exclude_self: bool = False, target: float = 0.9, sample: int = SAMPLE_QUERIES,
) -> int:
    """Probes with which the index finds ``target`` of the neighbours of ``sample`` queries.

    The sample (the least ids by hash) only sets this number; every reference row is indexed.
    """
    some = query.orderBy(F.xxhash64(query_id), query_id).limit(sample)
    kept = _distinct_refs(ref, vec, k + exclude_self)
    n, width = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return 1
    cells = _cells(kept, n, width, metric)
    near = knn_join(some, ref, query_id, vec, k, metric, exclude_self).select(query_id, "ref_id")
    pairs = near.join(some.select(query_id, F.col(vec).alias("q")), query_id).join(
        ref.select("ref_id", F.col(vec).alias("v")), "ref_id").select("q", "v")

    def places(frames):
        for pdf in cells.pieces(frames):
            home, d = cells.to(_vectors(pdf["v"])).argmin(axis=1), cells.to(_vectors(pdf["q"]))
            yield pd.DataFrame({"place": (d < d[np.arange(len(d)), home][:, None]).sum(axis=1) + 1})

    # at most ``sample`` times k numbers
    at = [r["place"] for r in pairs.mapInPandas(places, "place long").collect()]
    return int(np.sort(at)[min(len(at) - 1, int(np.ceil(target * len(at))))]) if at else 1


def knn_join(
    query: DataFrame, ref: DataFrame, query_id: str, vec: str, k: int, metric: str = "l2",
    exclude_self: bool = False, probes: int | None = None, counter=None,
) -> DataFrame:
    """(query_id, ref_id, ref_label, dist, rank): the k nearest rows of ``ref(ref_id, vec, ref_label)``.

    ``query_id`` names each query once.  Equal distances are ordered by ``ref_id``; null vectors have
    no neighbours and are none.  With ``exclude_self`` a row is not its own neighbour.  Without
    ``probes`` the answer is exact; with it only the ``probes`` nearest cells are searched.
    ``counter`` (an accumulator) gets the number of pairs that were compared.
    """
    want = k + 1 if exclude_self else k
    ref = _distinct_refs(ref, vec, want)
    query = query.select(query_id, F.col(vec).alias("v")).where("v is not null")
    n, width = ref.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return query.join(ref, F.lit(False)).select(
            query_id, "ref_id", "ref_label", F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    block = _block(n, ref.sparkSession)
    cells = _cells(ref, n, width, metric, block)

    def place(frames):
        for pdf in cells.pieces(frames):
            d = cells.to(_vectors(pdf["v"]))
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype("int32"), region=cells.region[cell].astype("int32"), pd=d[np.arange(len(cell)), cell])

    extra = [T.StructField("cell", T.IntegerType()), T.StructField("region", T.IntegerType()), T.StructField("pd", T.DoubleType())]
    placed = cut_lineage(ref.mapInPandas(place, T.StructType([*ref.schema.fields, *extra])))
    # per cell: two bounds and at most ``want`` distances
    cells.know(placed.groupBy("cell").agg(F.min("pd").alias("low"), F.max("pd").alias("high")).collect(),
               _smallest(placed.select("cell", "pd", "ref_id"), ["cell"], ["pd", "ref_id"], want).select("cell", "pd").collect(), want)

    visit = T.StructType([query.schema[query_id], T.StructField("region", T.IntegerType()),
                          *[T.StructField(c, T.DoubleType()) for c in ("radius", "own")]])

    def visited(pdf: pd.DataFrame, asked: np.ndarray, own: np.ndarray, radius: np.ndarray) -> pd.DataFrame:
        """One visit for each query and region of the asked cells."""
        q, g = cells.regions_of(asked)
        return pd.DataFrame({query_id: pdf[query_id].to_numpy()[q], "region": g.astype("int32"), "radius": radius[q], "own": own[q]})

    def own_cell(frames):
        for pdf in cells.pieces(frames):
            d = cells.to(_vectors(pdf["v"]))
            few = 1 if probes is None else min(probes, d.shape[1])
            own = np.partition(d, few - 1, axis=1)[:, few - 1]
            r = cells.first_radius(d, want) if probes is None else np.full(len(d), np.inf)
            yield visited(pdf, d <= own[:, None], own, r)

    def other_cells(frames):
        for pdf in cells.pieces(frames):
            d, r = cells.to(_vectors(pdf["v"])), pdf["radius"].to_numpy(dtype=float)
            own = d.min(axis=1)
            yield visited(pdf, cells.asked(d, slice(None), own, r, "others"), own, r)

    visits = cut_lineage(query.mapInPandas(own_cell, visit))
    near = _meet(visits, query, placed, cells, query_id, "own", want, block, counter)
    if probes is None:
        near = cut_lineage(_first(near, [query_id], ["dist", "ref_id"], want))
        radius = near.where(F.col("__r") == want).select(query_id, F.col("dist").alias("__far"))
        # ties of the nearest pivot give several visits with one radius
        first = visits.groupBy(query_id).agg(F.min("radius").alias("radius")).join(radius, query_id, "left").select(
            query_id, F.least("radius", F.coalesce("__far", "radius")).alias("radius"))
        asked = query.join(first, query_id)
        visits = cut_lineage(asked.mapInPandas(other_cells, visit))
        near = near.drop("__r").unionByName(_meet(visits, query, placed, cells, query_id, "others", want, block, counter))
    if exclude_self:
        near = near.where(F.col(query_id) != F.col("ref_id"))
    return _first(near, [query_id], ["dist", "ref_id"], k).withColumnRenamed("__r", "rank")


def recall(found: DataFrame, exact: DataFrame, query_id: str) -> DataFrame:
    """One row: share of the exact neighbours that are found at no greater distance (ties count)."""
    worst = exact.groupBy(query_id).agg(F.max("dist").alias("__far"), F.count("*").alias("__k"))
    hits = found.join(worst, query_id).groupBy(query_id, "__k").agg(
        F.sum((F.col("dist") <= F.col("__far") * (1 + 1e-9)).cast("long")).alias("__hit"))
    every = worst.select(query_id, "__k").join(hits.select(query_id, "__hit"), query_id, "left")
    return every.agg(
        (F.sum(F.least(F.coalesce("__hit", F.lit(0)), F.col("__k"))) / F.sum("__k")).alias("recall"), F.count("*").alias("queries"))


def knn_vote(near: DataFrame, query_id: str, weights: str = "uniform") -> DataFrame:
    """(query_id, score): mean label of the neighbours, or weighted by 1/distance.

    If any distance is zero only the zero-distance neighbours vote.
    """
    if weights == "uniform":
        return near.groupBy(query_id).agg(F.avg("ref_label").alias("score"))
    zero = F.max((F.col("dist") == 0).cast("int")) == 1
    exact = F.avg(F.when(F.col("dist") == 0, F.col("ref_label")))
    w = F.when(F.col("dist") > 0, 1 / F.col("dist"))
    return near.groupBy(query_id).agg(
        F.when(zero, exact).otherwise(F.sum(w * F.col("ref_label")) / F.sum(w)).alias("score")
    )


def knn_class(near: DataFrame, query_id: str) -> DataFrame:
    """Majority label of the neighbours (smallest label on a tie)."""
    votes = near.groupBy(query_id, "ref_label").agg(F.count("*").alias("n"))
    return votes.groupBy(query_id).agg(
        F.min_by("ref_label", F.struct(-F.col("n"), F.col("ref_label"))).alias("predicted")
    )
