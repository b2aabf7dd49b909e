"""Vector search for tables of queries: an inverted file of trained cells, and the exact scan as its case of one cell.

`train` fits centroids on a bounded sample in hash order, and measures on it how many
cells a query has to ask for the recall that is wanted: few where vectors cluster, many
where they do not. `cells` gives every row its nearest cell; `search` sends each query
to the cells nearest to it and meets their rows by an equi join on cell and block. A cell is as many blocks as its size asks for, so a
hot cell is no single task, and a query is copied once for each block of its cells.

Null vectors and those of no length have no neighbours. Distances are cosine, ties by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that centroids are fitted on, in hash order of the key.
SAMPLE = 20_000
#: Rows a cell holds on average, and most cells; their centroids are broadcast.
CELL_ROWS, MOST_CELLS = 100, 4096
ROUNDS = 12
#: Recall of the nearest others on the sample that fixes how many cells a query asks, and the queries of that.
RECALL, TRIALS = 0.95, 400
#: Rows of a block and queries that meet one at once.
BLOCK, QUERIES = 8192, 1024
#: Products of rows and centroids that are held at once, however many rows a batch has.
PRODUCTS = 1 << 20
#: Copies of rows, one a cell asked, that leave at once.
COPIES = 1 << 13


def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at length one, and which have a length."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    long = np.sqrt((x * x).sum(axis=1))
    return x / np.where(long > 0, long, 1)[:, None], long > 0


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The `n` nearest centroids of each row, nearest first, ties by number; few rows at once, so memory follows neither rows nor cells."""
    step = max(1, PRODUCTS // max(1, len(centres)))
    near = [np.zeros((0, min(n, len(centres))), dtype=np.int64)]
    for a in range(0, len(x), step):
        products = x[a : a + step] @ centres.T
        near.append(products.argmax(axis=1)[:, None] if n == 1 else np.argsort(-products, axis=1, kind="stable")[:, :n])
    return np.concatenate(near)


def _enough_probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Cells, nearest first, that hold `recall` of the `k` nearest others of sampled queries among the sample."""
    asked = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    own = nearest_centres(x, centres)[:, 0]
    order = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), axis=1)
    near = x[asked] @ x.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not best.size:
        return 1
    needed = np.sort(np.take_along_axis(order, own[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def train(vectors: DataFrame, key: str, vector: str, k: int = 10, recall: float = RECALL, n_cells: int | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, int]:
    """Centroids of unit length by spherical k-means on at most `sample` rows, about one for CELL_ROWS rows of the
    table, and the number of cells to ask for `recall` of `k` neighbours."""
    held = vectors.filter(F.col(vector).isNotNull())
    cells = n_cells or min(MOST_CELLS, max(1, held.count() // CELL_ROWS))
    rows = held.select(vector, key).orderBy(F.xxhash64(key), key).limit(sample).toPandas()
    x, long = unit(rows[vector])
    x = x[long]
    if not len(x):
        return np.zeros((0, 1)), 1
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = nearest_centres(x, centres)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        long = np.linalg.norm(sums, axis=1)
        centres = np.where(long[:, None] > 0, sums / np.where(long > 0, long, 1)[:, None], centres)
    return centres, _enough_probes(x, centres, k, recall)


def _nearest_cells(sent, vector: str, probes: int) -> Callable:
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres = sent.value
        for b in batches:
            x, long = unit(b[vector])
            b, x = b[long], x[long]
            if len(b) and len(centres):
                near = nearest_centres(x, centres, probes)
                step = max(1, COPIES // near.shape[1])
                for a in range(0, len(b), step):
                    own, to = b.iloc[a : a + step], near[a : a + step]
                    yield own.loc[own.index.repeat(to.shape[1])].assign(cell=to.ravel())

    return place


def cells(rows: DataFrame, vector: str, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """`rows` with `cell`: one row for each of the `probes` nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    held = rows.filter(F.col(vector).isNotNull())
    kind = ", ".join(f"`{n}` {t}" for n, t in held.dtypes)
    return held.mapInPandas(_nearest_cells(sent, vector, probes), f"{kind}, cell int")


def search(queries: DataFrame, placed: DataFrame, key: str, vector: str, k: int, centres: np.ndarray, probes: int, block: int = BLOCK) -> DataFrame:
    """query, `key`, distance and place (from 1): the `k` nearest rows of `placed` (see `cells`), a query itself among them."""
    kind = dict(placed.dtypes)[key]
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))  # a row a cell
    dealt = lambda n, name: F.pmod(F.xxhash64(key, F.lit(name)), n).cast("int")
    asked = cells(queries.select(key, vector), vector, centres, probes).join(F.broadcast(sizes), "cell")
    n_parts = F.lit(max(1, -(-queries.count() // QUERIES)))
    q = asked.select(key, vector, "cell", dealt(n_parts, "queries").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    r = placed.join(F.broadcast(sizes), "cell").select(key, vector, "cell", dealt(F.col("blocks"), "rows").alias("block"))
    # a block of rows goes to the parts of queries that ask it
    parts = q.select("cell", "block", F.col("part").alias("to")).distinct()
    r = r.join(parts, ["cell", "block"])

    def meet(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(asked) and len(rows):
            (x, _), (y, _), keys = unit(asked[vector]), unit(rows[vector]), rows[key].to_numpy()
            for own, v in zip(asked[key], x, strict=True):
                distance = np.round(1 - y @ v, 6) + 0.0
                best = np.lexsort((keys, distance))[:k]
                out.append((np.full(len(best), own), keys[best], distance[best]))
        return pd.DataFrame(dict(zip(("query", key, "distance"), map(np.concatenate, zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({"query": pd.Series(dtype=int), key: pd.Series(dtype=int), "distance": pd.Series(dtype=float)})

    met = q.groupBy("cell", "block", "part").cogroup(r.groupBy("cell", "block", "to")).applyInPandas(meet, f"query {kind}, {key} {kind}, distance double")
    return met.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy("distance", key))).filter(F.col("place") <= k)


def exact(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """The same from all rows: one cell, in blocks."""
    first = vectors.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    centres = np.zeros((1, first[0] if first else 1))
    return search(queries, cells(vectors.select(key, vector), vector, centres), key, vector, k, centres, 1, block)


def approximate(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, recall: float = RECALL) -> DataFrame:
    """The same from the cells nearest to each query, of an index of all rows."""
    centres, probes = train(vectors, key, vector, k, recall)
    return search(queries, cells(vectors.select(key, vector), vector, centres), key, vector, k, centres, probes)
