"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one per half of the vector, form a grid of cells. A vector visits cells in order of
summed distance (the multi-sequence order) and is compared with what they hold. How many cells are
visited is measured: a bounded set of sample vectors is compared with every vector, and the visits
are set so that the wanted share of their true links would be found. Equal vectors are one class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from siteweave.llm.components import components, forest
from siteweave.plans.stages import written

# Vectors per cell on average, codewords per half at most, and sample sizes.
CELL_ROWS = 64
MAX_CODEWORDS = 1024
TRAIN_ROWS = 20_000
PROBE_ROWS = 2000
TARGET_RECALL = 0.995
LEAST_VISITS = 4
# Vectors of a cell that one task holds; fuller cells are dealt to several.
BLOCK = 16_384
# Cosines computed at a time.
PAIRS = 1 << 21
_STEP = 1.1


def _matrix(column, dims: int):
    """Arrow list column of equal-sized lists -> rows of length one in double precision."""
    import numpy as np

    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    # scaled first, so that very large and very small components keep their squares
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _kmeans(x, k: int, rounds: int = 12):
    """Lloyd's codebook on a bounded sample, started from rows that lie far apart."""
    import numpy as np

    centers = x[:1]
    far = ((x - centers[0]) ** 2).sum(axis=1)
    while len(centers) < k and far.max() > 1e-12:
        # far from the others, yet not the farthest, which may be an outlier
        pick = int(np.argsort(far, kind="stable")[int(len(far) * 0.9)])
        pick = pick if far[pick] > 1e-12 else int(far.argmax())
        centers = np.vstack([centers, x[pick]])
        far = np.minimum(far, ((x - x[pick]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = _distances(x, centers).argmin(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))[:, None]
        centers = np.where(n > 0, sums / np.maximum(n, 1), centers)
    return centers


def _distances(x, centers):
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None, :]


class Grid:
    """Codebooks of both halves; cells are numbered first * len(second) + second."""

    def __init__(self, first, second):
        self.first, self.second, self.half = first, second, first.shape[1]

    def halves(self, x):
        return _distances(x[:, : self.half], self.first), _distances(x[:, self.half :], self.second)

    def cells(self, x):
        a, b = self.halves(x)
        return a.argmin(axis=1) * len(self.second) + b.argmin(axis=1)

    def visits(self, x, n: int):
        """The ``n`` nearest cells of each row in multi-sequence order.

        The pair at places (i, j) of the two sorted halves has (i + 1)(j + 1) pairs no farther than
        itself, so only places with (i + 1)(j + 1) <= n can be among the first n.
        """
        import numpy as np

        a, b = self.halves(x)
        at_a, at_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        places = [(i, j) for i in range(min(n, a.shape[1])) for j in range(min(n // (i + 1), b.shape[1]))]
        i, j = np.array(places).T
        far = np.take_along_axis(a, at_a, 1)[:, i] + np.take_along_axis(b, at_b, 1)[:, j]
        order = np.argsort(far, axis=1, kind="stable")[:, :n]
        rows = np.arange(len(x))[:, None]
        return at_a[rows, i[order]] * len(self.second) + at_b[rows, j[order]]

    def rank(self, x, cell):
        """Cells no farther from each row than the given one (1: it is the nearest)."""
        import numpy as np

        a, b = self.halves(x)
        rows = np.arange(len(x))
        far = a[rows, cell // len(self.second)] + b[rows, cell % len(self.second)]
        out = np.zeros(len(x), dtype=np.int64)
        for r in rows:
            out[r] = np.searchsorted(np.sort(b[r]), far[r] - a[r] + 1e-12, "right").sum()
        return np.maximum(out, 1)


def _classes(vectors: DataFrame, column: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """One row per distinct usable vector (cls, embedding, n, first), and how many there are of each length."""
    usable = F.coalesce(
        (F.size(column) > 0)
        & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
        & F.exists(column, lambda v: v != 0),
        F.lit(False),
    )
    grouped = vectors.where(usable).groupBy(F.col(column).alias("embedding")).agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first")
    )
    classes = written(grouped.withColumn("cls", F.monotonically_increasing_id()), "vectors")
    lengths = classes.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect()
    return classes, [(r.d, r["count"]) for r in lengths]


def _train(classes: DataFrame, dims: int, total: int) -> Grid:
    import numpy as np

    k = min(MAX_CODEWORDS, max(1, round(math.sqrt(total / CELL_ROWS))))
    rate = min(1.0, TRAIN_ROWS / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 24)) < int(rate * (1 << 24))).select("embedding")
    rows = drawn.limit(2 * TRAIN_ROWS).toArrow()  # bounded by the draw; the limit only states it
    x = _matrix(rows.column(0).combine_chunks(), dims) if rows.num_rows else np.zeros((1, dims))
    x = x[np.lexsort(x.T)]
    half = max(1, dims // 2)
    return Grid(_kmeans(x[:, :half], k), _kmeans(x[:, half:], k) if dims > 1 else np.zeros((1, 0)))


def _visits_needed(classes: DataFrame, dims: int, grid, total: int, least: float, target: float) -> int:
    """Cells to visit so that the wanted share of the sample's true links lies within them."""
    import numpy as np

    rate = min(1.0, PROBE_ROWS / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64("embedding", F.lit(1)), F.lit(1 << 24)) < int(rate * (1 << 24))).select("cls", "embedding")
    rows = drawn.limit(2 * PROBE_ROWS).toArrow()
    if not rows.num_rows:
        return 1
    context = classes.sparkSession.sparkContext
    probes = context.broadcast((np.array(rows.column(0)), _matrix(rows.column(1).combine_chunks(), dims)))

    def run(batches):
        import pyarrow as pa

        ids, q = probes.value
        g = grid.value
        n_cells = len(g.first) * len(g.second)
        seen = {}
        for batch in batches:
            x, own = _matrix(batch.column(1), dims), batch.column(0).to_numpy()
            size = max(1, PAIRS // len(q))
            for at in range(0, len(x), size):
                near = (x[at : at + size] @ q.T >= least) & (own[at : at + size, None] != ids[None, :])
                t, p = np.nonzero(near)
                if not len(t):
                    continue
                both, n = np.unique(p * n_cells + g.cells(x[at : at + size])[t], return_counts=True)
                rank = g.rank(q[both // n_cells], both % n_cells)
                for key in zip((both // n_cells).tolist(), np.ceil(np.log(rank) / math.log(_STEP)).astype(int).tolist(), n.tolist()):
                    seen[key[:2]] = seen.get(key[:2], 0) + key[2]
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in seen], pa.int64()) for i in (0, 1)] + [pa.array(list(seen.values()), pa.int64())], names=["probe", "step", "n"]
        )

    # At most one row per probe and step.
    counts = classes.select("cls", "embedding").mapInArrow(run, "probe long, step long, n long").groupBy("probe", "step").agg(F.sum("n").alias("n")).collect()
    links: dict[int, int] = {}
    for r in counts:
        links[r.probe] = links.get(r.probe, 0) + r.n
    needed = LEAST_VISITS
    # once every group of linked vectors weighs about the same, however large, and once every link
    for weight in (lambda r: r.n / links[r.probe] ** 2, lambda r: r.n):
        by_step: dict[int, float] = {}
        for r in counts:
            by_step[r.step] = by_step.get(r.step, 0.0) + weight(r)
        found, wanted = 0.0, target * sum(by_step.values())
        for step in sorted(by_step):
            if found >= wanted:
                break
            found += by_step[step]
            needed = max(needed, math.floor(_STEP**step + 1e-9))
    return min(needed, len(grid.value.first) * len(grid.value.second))


def _compared(classes: DataFrame, dims: int, grid, visits: int, least: float) -> DataFrame:
    """(a, b, n): links of classes. Rows with ``b`` connect, rows without count linked vectors."""

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                x = _matrix(part.column(1), dims)
                cells = grid.value.visits(x, visits)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(grid.value.cells(x)), pa.array(cells.tolist(), pa.list_(pa.int64()))],
                    names=["cls", "embedding", "n", "home", "visits"],
                )

    kind = classes.schema["embedding"].dataType.simpleString()
    rows = written(classes.select("cls", "embedding", "n").mapInArrow(placed, f"cls long, embedding {kind}, n long, home long, visits array<long>"), "placed")
    crowded = written(
        rows.groupBy("home").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BLOCK)
        .select(F.col("home").alias("cell"), F.ceil(F.col("rows") / BLOCK).alias("blocks")),
        "crowded",
    )
    blocks = F.coalesce("blocks", F.lit(1))
    held = rows.withColumnRenamed("home", "cell").join(crowded, "cell", "left").select(
        "cell", F.pmod(F.xxhash64("cls"), blocks).alias("block"), F.lit(0).alias("role"), "cls", "n", "embedding"
    )
    asked = rows.withColumn("cell", F.explode("visits")).join(crowded, "cell", "left").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), F.lit(1).alias("role"), "cls", "n", "embedding"
    )
    dealt = held.unionByName(asked).repartition("cell", "block").sortWithinPartitions("cell", "block", "role", "cls")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        at_key, ids, number, x = None, None, None, None
        for batch in batches:
            cell, block, role, cls, n = (batch.column(i).to_numpy() for i in range(5))
            rows = _matrix(batch.column(5), dims) if batch.num_rows else None
            edges, counts = [], []
            cut = np.flatnonzero(np.diff(cell, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool) | np.diff(role, prepend=-1).astype(bool))
            for a, b in zip(cut, [*cut[1:], len(cell)]):
                key = (cell[a], block[a])
                if role[a] == 0:
                    same = at_key == key
                    ids = np.concatenate([ids, cls[a:b]]) if same else cls[a:b]
                    number = np.concatenate([number, n[a:b]]) if same else n[a:b]
                    x = np.vstack([x, rows[a:b]]) if same else rows[a:b]
                    at_key = key
                    continue
                if at_key != key:  # nobody lives in this cell
                    continue
                size = max(1, PAIRS // len(ids))
                for c in range(a, b, size):
                    d = min(b, c + size)
                    # each pair from the side with the smaller number
                    near = (rows[c:d] @ x.T >= least) & (cls[c:d, None] < ids[None, :])
                    if not near.any():
                        continue
                    q, t = np.nonzero(near)
                    edges.append(forest(cls[c:d][q], ids[t]))
                    counts += [(cls[c:d], near @ number), (ids, n[c:d] @ near)]
            if not counts:
                continue
            u, v = forest(*(np.concatenate(e) for e in zip(*edges)))
            who, where = np.unique(np.concatenate([i for i, _ in counts]), return_inverse=True)
            total = np.zeros(len(who), dtype=np.int64)
            np.add.at(total, where, np.concatenate([k for _, k in counts]))
            who, total = who[total > 0], total[total > 0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([u, who])), pa.array([*v.tolist(), *[None] * len(who)], pa.int64()), pa.array(np.concatenate([np.zeros(len(u), dtype=np.int64), total]))],
                names=["a", "b", "n"],
            )

    return written(dealt.mapInArrow(run, "a long, b long, n long"), "vector-links")


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.9, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector, links of cosine >= ``least``.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing and
    are their own component. Vectors link with those of their own length, each length on a grid of its own. Rows are vectors of their own,
    repeated or not. Of a component the vector with the smallest id is kept; null ids take the
    smallest id they reach, or null. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("embedding"))
    spark = vectors.sparkSession
    classes, lengths = _classes(rows, "embedding")
    links = spark.createDataFrame([], "a long, b long, n long")
    for dims, total in lengths:
        alike = classes.where(F.size("embedding") == dims)
        grid = spark.sparkContext.broadcast(_train(alike, dims, total))
        visits = _visits_needed(alike, dims, grid, total, least, target_recall)
        links = links.unionByName(_compared(alike, dims, grid, visits, least))
    parts = components(links.where("b is not null"), "a", "b")
    counted = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("links"))
    placed = classes.join(parts, classes.cls == parts.node, "left").join(counted, "cls", "left").select(
        "cls", "embedding", "n", "first", F.coalesce("component", "cls").alias("part"), F.coalesce("links", F.lit(0)).alias("links")
    )
    placed = written(placed, "placed")
    low = placed.groupBy("part").agg(F.min("first").alias("component_id"))
    known = placed.join(low, "part").select("embedding", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "embedding", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
