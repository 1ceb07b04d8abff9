"""Components, neighbours, graphs and clusters of units given as vectors: {vec}(id long, v array<double>).

Pairs of units are never listed all at once on the driver: neighbours and silhouettes are searched block by block, one
block of the queries against every block of the rows, inside tasks.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvellum.functions.sqltext import num, ranked

#: Rows that one block of a neighbour search holds.
BLOCK = 2048


def kept(df: DataFrame) -> DataFrame:
    """The same rows behind a checkpoint in the folder that the cluster names; a folder of our own is for local sessions."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvellum-ckpt-"))
    return df.checkpoint()


def summed(parts: DataFrame, key: str, columns: list[str]) -> pd.DataFrame:
    """Rows of partial sums (arrays) added up to one for each key: in two levels, so that the tasks add and the driver gets
    one row a key."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: frame[key].iloc[:1], **{c: [np.sum(np.stack(frame[c].to_numpy()), axis=0).tolist()] for c in columns}})

    schema = ", ".join([f"{key} long", *[f"{c} array<double>" for c in columns]])
    some = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(16))).groupBy(key, "lane").applyInPandas(lambda f: add(f.drop(columns="lane")), schema)
    return some.groupBy(key).applyInPandas(add, schema).toPandas()


def grams(vec: DataFrame, width: int, key: str = "run") -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """Mean vector, centred cross products and number of rows of each run of {vec}(run, v): ``width`` squared numbers a
    run and task. Tasks without rows (a split of a file that holds none, say) say nothing."""

    def run(batches):
        held: dict[int, list] = {}
        for frame in batches:
            for r, rows in frame.groupby(key)["v"]:
                x = np.stack(rows.to_numpy()).astype(float)
                n, t, g = held.get(r, (0, np.zeros(width), np.zeros((width, width))))
                held[r] = n + len(x), t + x.sum(0), g + x.T @ x
        if held:
            yield pd.DataFrame({key: list(held), "n": [[float(h[0])] for h in held.values()], "t": [h[1].tolist() for h in held.values()], "g": [h[2].ravel().tolist() for h in held.values()]})

    parts = vec.select(F.col(key).cast("long").alias(key), "v").mapInPandas(run, f"{key} long, n array<double>, t array<double>, g array<double>")
    out = {}
    for r in summed(parts, key, ["n", "t", "g"]).itertuples():
        n, mean = int(r.n[0]), np.array(r.t) / max(r.n[0], 1)
        out[int(getattr(r, key))] = mean, np.array(r.g).reshape(width, width) - n * np.outer(mean, mean), n
    return out


def gram(vec: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """`grams` of one run."""
    return grams(vec.select(F.lit(0).alias("run"), "v"), width).get(0, (np.zeros(width), np.zeros((width, width)), 0))


def principal_components(vec: DataFrame, width: int, k: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(id, scores) of the first k components, their variances, and loadings with the largest entry positive."""
    mean, g, n = gram(vec, width)
    value, axis = np.linalg.eigh(g / max(n - 1, 1))
    value, axis = np.maximum(value[::-1][:k], 0), axis[:, ::-1][:, :k]
    axis = axis * np.sign(axis[np.abs(axis).argmax(0), np.arange(axis.shape[1])])

    def run(batches):
        for frame in batches:
            x = np.stack(frame["v"].to_numpy()).astype(float) - mean if len(frame) else np.zeros((0, width))
            yield pd.DataFrame({"id": frame["id"], "scores": list(x @ axis)})

    return vec.select("id", "v").mapInPandas(run, "id long, scores array<double>"), value, axis


def shuffled_variances(vec: DataFrame, width: int, k: int, runs: int = 10, seed: int = 0) -> np.ndarray:
    """Largest variance of each component over runs in which every column is shuffled across the units on its own.

    Values of a run's column are ranked by a hash, and the unit of that rank gets them; ranks go bin by bin, so no task
    holds a column. All runs are done together.
    """
    spark = vec.sparkSession
    place = kept(spark.sql(f"WITH {ranked('{u}', 'h', 'id')} SELECT id, i FROM k", u=vec.select("id", F.xxhash64("id", F.lit(seed)).cast("double").alias("h"))))
    x = vec.select("id", F.posexplode("v").alias("c", "x")).crossJoin(F.broadcast(spark.range(runs).withColumnRenamed("id", "run")))
    x = x.select("id", "x", (F.col("run") * width + F.col("c")).alias("g"), F.xxhash64("run", "c", "id", F.lit(seed)).cast("double").alias("h"))
    moved = spark.sql(f"WITH {ranked('{x}', 'h', 'id', 'g')} SELECT g, i, x AS value FROM (SELECT k.g, k.i, k.x FROM k) z", x=x)
    rows = moved.join(place, "i").select("id", F.floor(F.col("g") / width).alias("run"), F.struct(F.pmod("g", F.lit(width)).alias("c"), "value").alias("y"))
    back = rows.groupBy("run", "id").agg(F.transform(F.array_sort(F.collect_list("y")), lambda y: y["value"]).alias("v"))
    best = np.zeros(k)
    for _, g, n in grams(back, width).values():
        best = np.maximum(best, np.maximum(np.linalg.eigvalsh(g / max(n - 1, 1))[::-1][:k], 0))
    return best


def component_choice(threshold: float = 0.9, basis: str = "signal") -> str:
    """How many components {eig}(pc from 1 on, eig, null_max, ratio) hold a share: of what rises above the null, counting the
    leading run of components above it (signal), or of all variance (total). One row: n, reached, lead (components above
    the null), elbow (farthest below the line from the first to the last), held (share of all variance)."""
    w = "CASE WHEN pc <= lead THEN eig - null_max ELSE CAST(0 AS DOUBLE) END" if basis == "signal" else "ratio"
    whole = "nullif(sum(w) OVER (), CAST(0 AS DOUBLE))" if basis == "signal" else "CAST(1 AS DOUBLE)"
    return f"""WITH l AS (SELECT *, coalesce(min(CASE WHEN eig <= null_max THEN pc END) OVER () - 1, count(*) OVER ()) AS lead, count(*) OVER () AS most, max(eig) OVER () AS top, min_by(eig, -pc) OVER () AS bottom FROM {{eig}}),
w AS (SELECT *, {w} AS w FROM l),
c AS (SELECT *, sum(w) OVER (ORDER BY pc) / {whole} AS share, sum(ratio) OVER (ORDER BY pc) AS total, 1 - (pc - 1) / CAST(greatest(most - 1, 1) AS DOUBLE) - (eig - bottom) / greatest(top - bottom, {num(1e-12)}) AS under FROM w),
n AS (SELECT max(lead) AS lead, max(most) AS most, min(CASE WHEN share >= {num(threshold - 1e-12)} THEN pc END) AS hit, max(share) IS NULL AS nothing, max_by(pc, struct(round(under, 12), -pc)) AS elbow FROM c)
SELECT CAST(CASE WHEN n.nothing THEN 0 ELSE coalesce(n.hit, n.most) END AS INT) AS n, n.nothing OR n.hit IS NOT NULL AS reached, CAST(n.lead AS INT) AS lead, CAST(n.elbow AS INT) AS elbow FROM n"""


def _cartesian(blocks: DataFrame, n: int) -> DataFrame:
    """Every block beside every block, as columns q_* and r_*: tasks hold one block q, or few, and meet the blocks r of a lane one
    after another; a lane has 64 blocks or fewer (if there are over 256), so it fits a task at any size."""
    lanes = max(4, -(-n // 64))
    q = blocks.select(*[F.col(c).alias(f"q_{c}") for c in blocks.columns])
    r = blocks.select(*[F.col(c).alias(f"r_{c}") for c in blocks.columns]).coalesce(lanes)
    return q.crossJoin(r.hint("shuffle_replicate_nl"))


def _blocks(vec: DataFrame, block: int) -> tuple[DataFrame, int]:
    """Vectors of {vec}(id, v) or (id, v, label) in blocks of about ``block`` rows (b, ids, vs, names), as bytes, and how many
    blocks. The rows of a block go by label and id."""
    n = max(1, -(-vec.count() // block))
    cols = vec.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"), "id", "v", (F.col("label").cast("string") if "label" in vec.columns else F.lit("")).alias("label"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "id"], kind="stable")
        v = np.stack([np.asarray(x, float) for x in frame["v"]])
        return pd.DataFrame({"b": frame["b"].iloc[:1], "ids": [frame["id"].to_numpy("int64").tobytes()], "vs": [v.tobytes()], "names": [frame["label"].tolist()]})

    return kept(cols.groupBy("b").applyInPandas(pack, "b long, ids binary, vs binary, names array<string>").repartition(n)), n


def _unpacked(ids: bytes, vs: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "int64")
    return i, np.frombuffer(vs, float).reshape(len(i), -1)


def _sizes(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    return np.einsum("ij,ij->i", x, x)


class _Nearest:
    """The k nearest that a block of queries has met so far: distances by differences, ties by id.

    Products of matrices in single precision rule out who can't be among them, with a bound for their error; the rest are
    measured by differences, so results don't depend on how rows are put into blocks.
    """

    STEP, CELLS = 256, 2_000_000

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        fine = v[np.isfinite(v).all(1)]
        self.centre = fine.mean(0) if len(fine) else np.zeros(v.shape[1])
        self.far = np.full((len(ids), k), np.inf)
        self.other = np.full((len(ids), k), np.iinfo("int64").max)

    def meet(self, ids: np.ndarray, v: np.ndarray) -> None:
        x, y = self.v - self.centre, v - self.centre
        xs, ys = _sizes(x), _sizes(y)
        exact = not max(xs.max(initial=0), ys.max(initial=0)) < 1e30
        kind, unit = (float, 2.0**-52) if exact else (np.float32, 2.0**-23)
        long = np.sqrt(ys[np.isfinite(ys)].max(initial=0))
        margin = (v.shape[1] + 16) * unit * (np.sqrt(xs) + long) ** 2
        xk, yk, yn = x.astype(kind), y.astype(kind).T, ys.astype(kind)
        for at in range(0, len(x), self.STEP):
            to = slice(at, at + self.STEP)
            with np.errstate(all="ignore"):
                near = xk[to] @ yk
                near *= -2
                near += yn
                most = self.far[to, -1] ** 2 * (1 + 1e-12) + margin[to] - xs[to]
                new = np.isinf(self.far[to, -1])
                if new.any() and len(ids) > self.k + 1:
                    part = np.partition(np.where(np.isnan(near[new]), np.inf, near[new]), self.k, axis=1)[:, self.k]
                    most[new] = part + 2 * margin[to][new]
                a, b = np.nonzero(near <= most[:, None].astype(kind) if not new.any() else near <= most[:, None])
            a += at
            other = self.ids[a] != ids[b]
            self._take(a[other], b[other], ids, v)

    def _take(self, a: np.ndarray, b: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        step = max(1, self.CELLS // max(v.shape[1], 1))
        for i in range(0, len(a), step):
            p, o = a[i : i + step], b[i : i + step]
            d = np.sqrt(((self.v[p] - v[o]) ** 2).sum(1))
            good = (d <= self.far[p, -1]) & (d < np.inf)
            p, o, d = p[good], ids[o[good]], d[good]
            if not len(p):
                continue
            rows = np.unique(p)
            p = np.concatenate([np.repeat(rows, self.k), p])
            o, d = np.concatenate([self.other[rows].ravel(), o]), np.concatenate([self.far[rows].ravel(), d])
            order = np.lexsort((o, d, p))
            p, o, d = p[order], o[order], d[order]
            first = np.searchsorted(p, rows)[:, None] + np.arange(self.k)
            self.far[rows], self.other[rows] = d[first], o[first]

    def found(self) -> pd.DataFrame:
        a, c = np.nonzero(self.far < np.inf)
        return pd.DataFrame({"id": self.ids[a], "other": self.other[a, c], "distance": self.far[a, c]})


def nearest(vec: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, other, distance, place) of the k nearest others by Euclidean distance, exact; ties by id.

    Blocks of rows meet blocks of rows, lane by lane; a lane gives at most k rows for each query, so what is shuffled is
    queries times lanes times k, not pairs. The work is quadratic.
    """
    blocks, n = _blocks(vec.select("id", "v"), block)

    def run(batches):
        now, held = None, None
        for frame in batches:
            for b, qi, qv, ri, rv in zip(*(frame[c] for c in ("q_b", "q_ids", "q_vs", "r_ids", "r_vs")), strict=True):
                if b != now:
                    if held is not None:
                        yield held.found()
                    now, held = b, _Nearest(*_unpacked(qi, qv), k)
                held.meet(*_unpacked(ri, rv))
        if held is not None:
            yield held.found()

    found = _cartesian(blocks.select("b", "ids", "vs"), n).mapInPandas(run, "id long, other long, distance double")
    w = Window.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _label_sums(x: np.ndarray, y: np.ndarray, starts: np.ndarray, step: int = 128) -> np.ndarray:
    """Sums of distances of each of x to the stretches of y that begin at ``starts``: by products of matrices, and by
    differences where two are so near that those would lose digits."""
    centre = x.mean(0)
    xc, yc = x - centre, y - centre
    xs, ys, out = _sizes(xc), _sizes(yc), np.empty((len(x), len(starts)))
    yt = yc.T.copy()
    for at in range(0, len(x), step):
        to = slice(at, at + step)
        d = xc[to] @ yt
        d *= -2
        d += ys
        d += xs[to, None]
        a, b = np.nonzero(d < 1e-6 * (xs[to, None] + ys.max()))
        np.maximum(d, 0, out=d)
        np.sqrt(d, out=d)
        for i in range(0, len(a), 32768):
            p, o = a[i : i + 32768], b[i : i + 32768]
            d[p, o] = np.sqrt(((x[p + at] - y[o]) ** 2).sum(1))
        out[to] = np.add.reduceat(d, starts, axis=1)
    return out


def silhouette(vec: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, silhouette) by Euclidean distances; ``labels`` is (id, label). Blocks add sums of distances per label, and a task
    those of its lane. The work is quadratic."""
    rows, n = _blocks(vec.join(labels, "id").select("id", "v", "label"), block)

    def told(ids, names, sums):
        for other, s in sums.items():
            yield pd.DataFrame({"id": ids, "label": names, "other": other, "s": s})

    def run(batches):
        now, held = None, None
        for frame in batches:
            for b, qi, qv, qn, ri, rv, rn in zip(*(frame[c] for c in ("q_b", "q_ids", "q_vs", "q_names", "r_ids", "r_vs", "r_names")), strict=True):
                if b != now:
                    if held is not None:
                        yield from told(*held)
                    now, held = b, (np.frombuffer(qi, "int64"), list(qn), {})
                name = np.array(["\0" if x is None else f"={x}" for x in rn])
                starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
                sums = _label_sums(_unpacked(qi, qv)[1], _unpacked(ri, rv)[1], starts)
                for j, at in enumerate(starts):
                    held[2][rn[at]] = held[2].get(rn[at], 0.0) + sums[:, j]
        if held is not None:
            yield from told(*held)

    sums = _cartesian(rows, n).mapInPandas(run, "id long, label string, other string, s double").groupBy("id", "label", "other").agg(F.sum("s").alias("s"))
    size = labels.groupBy(F.col("label").cast("string").alias("other")).agg(F.count("*").alias("n"))
    m = sums.join(F.broadcast(size), "other").withColumn("mean", F.when(F.col("label") == F.col("other"), F.col("s") / F.nullif(F.col("n") - 1, F.lit(0))).otherwise(F.col("s") / F.col("n")))
    g = m.groupBy("id").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("mean"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("mean"))).alias("b"))
    return g.select("id", F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)).alias("silhouette"))


def mixing(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean entropy of the labels around each unit, over the entropy of all labels: 1 is fully mixed."""
    n = neighbours.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id", "label").agg(F.count("*").alias("k"))
    p = n.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy("id"))).groupBy("id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    o = labels.groupBy("label").agg(F.count("*").alias("k")).crossJoin(labels.agg(F.count("*").alias("n"))).agg((-F.sum(F.col("k") / F.col("n") * F.log(F.col("k") / F.col("n")))).alias("all"))
    return p.agg(F.avg("h").alias("h")).crossJoin(o).select((F.col("h") / F.greatest("all", F.lit(1e-12))).alias("mixing"))


def nearest_centroids(vec: DataFrame, labels: DataFrame) -> DataFrame:
    """Unordered pairs of labels of which one has the other's centroid nearest; there is one row per label to compare."""
    c = vec.join(labels, "id").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    d = c.alias("a").join(c.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.label") != F.col("b.label"))).groupBy(F.col("a.label").alias("a"), F.col("b.label").alias("b")).agg(F.sqrt(F.sum((F.col("a.m") - F.col("b.m")) ** 2)).alias("d"))
    near = d.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) and their reverse, made in one pass: a union would make the edges twice."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.inline(F.array(F.struct("src", "dst", *rest), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))))


def shared_neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """(src, dst, weight) in both directions: the Jaccard overlap of the neighbours of neighbouring units. The neighbours are
    used three times, so they are kept: the search for them is the quadratic part."""
    near = kept(neighbours.select("id", "other"))
    sets = near.groupBy("id").agg(F.collect_set("other").alias("s"))
    e = near.select(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).distinct()
    j = e.join(sets.select(F.col("id").alias("src"), F.col("s").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("s").alias("b")), "dst")
    return both_ways(j.select("src", "dst", (F.greatest(F.size(F.array_intersect("a", "b")), F.lit(1)) / F.size(F.array_union("a", "b"))).alias("weight")))


def graph_components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, component) by least labels and their labels, until nothing moves."""
    e = kept(edges.select("src", "dst").distinct())
    label = kept(ids.select("id", F.col("id").alias("component")))
    while True:
        near = e.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        low = label.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        new = kept(low.join(label.select(F.col("id").alias("low"), F.col("component").alias("far")), "low").select("id", "component", F.least("low", "far").alias("new")))
        moved = new.where("new < component").limit(1).count()
        label = new.select("id", F.col("new").alias("component"))
        if not moved:
            return label


def stranded(components: DataFrame, least: int = 10) -> DataFrame:
    """Units in components of too few."""
    n = components.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") < least)
    return components.join(n, "component").select("id", "component", "size")


def communities(edges: DataFrame, resolution: float = 1.0, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(id, cluster) by greedy modularity in the style of Louvain, synchronous: in each round every unit looks for the
    neighbouring cluster with the largest gain, and a hashed half of them move. "0" is the largest cluster.

    Edges stay distributed; a round is one aggregation of edges by unit and cluster and joins on the two keys.
    """
    e = kept(edges.where("src <> dst"))
    total = e.agg(F.sum("weight")).first()[0] or 1.0
    k = kept(e.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k")))
    label = kept(k.select("id", F.col("id").alias("c"), "k"))
    for r in range(rounds):
        mass = label.groupBy("c").agg(F.sum("k").alias("mass"))
        to = e.join(label.select(F.col("id").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("weight").alias("w"))
        to = to.unionByName(label.select("id", "c", F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
        own = label.select("id", F.col("c").alias("now"), "k")
        g = to.join(own, "id").join(mass, "c").withColumn("gain", F.round(F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0.0)) / total, 12))
        best = g.groupBy("id", "now", "k").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("best"))
        may = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), "id"), F.lit(2)) == 0
        new = kept(best.select("id", F.when(may | F.lit(r >= rounds - 2) & (F.col("best") < F.col("now")), F.col("best")).otherwise(F.col("now")).alias("c"), "now", "k"))
        moved = new.where("c <> now").limit(1).count()
        label = new.select("id", "c", "k")
        if not moved and r % 2:
            break
    size = label.groupBy("c").agg(F.count("*").alias("n"))
    place = size.withColumn("cluster", (F.row_number().over(Window.orderBy(F.desc("n"), "c")) - 1).cast("string"))
    return label.join(F.broadcast(place), "c").select("id", "cluster")


def picked_resolution(table: DataFrame, min_stability: float = 0.8, min_size: int = 10):
    """The finest resolution whose clusters are stable, large and not told to be alike, else the most stable with two or
    more; over (resolution, n_clusters, stability, min_size, distinct)."""
    ok = (F.col("n_clusters") >= 2) & (F.col("stability") >= min_stability) & (F.col("min_size") >= min_size) & F.coalesce(F.col("distinct"), F.lit(True))
    row = table.agg(F.max(F.when(ok, F.col("resolution"))).alias("fine"), F.max_by("resolution", F.when(F.col("n_clusters") >= 2, F.col("stability"))).alias("stable")).first()
    return row.fine if row.fine is not None else row.stable


def centred_batches(vec: DataFrame, batches: DataFrame, clusters: DataFrame) -> DataFrame:
    """Vectors less their batch's mean within a cluster, plus the cluster's mean: an approximation of soft-cluster
    batch correction, with hard clusters."""
    x = vec.join(batches, "id").join(clusters, "id").select("id", "batch", "cluster", F.posexplode("v").alias("i", "x"))
    m = x.groupBy("cluster", "batch", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    c = m.groupBy("cluster", "i").agg((F.sum("s") / F.sum("n")).alias("all"))
    shift = m.join(c, ["cluster", "i"]).select("cluster", "batch", "i", (F.col("all") - F.col("s") / F.col("n")).alias("d"))
    y = x.join(F.broadcast(shift), ["cluster", "batch", "i"]).select("id", "i", (F.col("x") + F.col("d")).alias("x"))
    return y.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))


def programs(vec: DataFrame, width: int, ks: tuple[int, ...], rounds: int = 60, seed: int = 0) -> list[np.ndarray]:
    """Non-negative programs (k by width) of non-negative vectors by multiplicative updates, one fit for each of ``ks``,
    each from a start of its own. All fits share the passes over the rows. Programs live on the driver (k times width
    numbers a fit); usages are made anew in the tasks, which return sums of that size only."""
    hs = [np.random.default_rng([seed, i]).random((k, width)) + 0.1 for i, k in enumerate(ks)]
    going = list(range(len(ks)))
    v = vec.select("v").persist()

    def pass_over(now: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        def run(batches):
            sums = {i: (np.zeros((len(h), width)), np.zeros((len(h), len(h)))) for i, h in now.items()}
            for frame in batches:
                if not len(frame):
                    continue
                x = np.maximum(np.stack(frame["v"].to_numpy()).astype(float), 0)
                for i, h in now.items():
                    w, xh, hh = np.full((len(x), len(h)), 1.0), x @ h.T, h @ h.T
                    for _ in range(20):
                        w *= xh / np.maximum(w @ hh, 1e-12)
                    sums[i] = sums[i][0] + w.T @ x, sums[i][1] + w.T @ w
            yield pd.DataFrame({"fit": list(sums), "a": [a.ravel().tolist() for a, _ in sums.values()], "b": [b.ravel().tolist() for _, b in sums.values()]})

        got = summed(v.mapInPandas(run, "fit long, a array<double>, b array<double>"), "fit", ["a", "b"])
        return {int(r.fit): (np.array(r.a).reshape(-1, width), np.array(r.b).reshape(len(now[r.fit]), -1)) for r in got.itertuples()}

    for _ in range(rounds):
        for i, (a, b) in pass_over({i: hs[i] for i in going}).items():
            new = hs[i] * a / np.maximum(b @ hs[i], 1e-12)
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
            if np.abs(new - hs[i]).max() < 1e-4:
                going.remove(i)
            hs[i] = new
        if not going:
            break
    v.unpersist()
    return hs


def stable_programs(vec: DataFrame, width: int, ks: tuple[int, ...] = (5, 8, 12), restarts: int = 3, least: float = 0.8, rounds: int = 60, seed: int = 0) -> tuple[int, bool, list[tuple[int, float]], np.ndarray]:
    """The largest number of programs whose restarts agree: (k, whether any agreed, (k, agreement) of all, programs).

    Agreement is the mean, over programs of the first start, of the best cosine with a program of another start. If none
    reaches ``least``, the k that agrees best is taken.
    """
    hs = programs(vec, width, tuple(k for k in ks for _ in range(restarts)), rounds, seed)
    table, first = [], {}
    for j, k in enumerate(ks):
        unit = [h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12) for h in hs[j * restarts : (j + 1) * restarts]]
        table.append((k, float(np.mean([(unit[0] @ u.T).max(1).mean() for u in unit[1:]])) if restarts > 1 else float("nan")))
        first[k] = hs[j * restarts]
    agreed = [k for k, a in table if a >= least]
    k = max(agreed) if agreed else max(table, key=lambda t: t[1])[0]
    return k, bool(agreed), table, first[k]
