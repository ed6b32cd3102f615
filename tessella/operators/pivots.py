"""A pivot index over vectors by class, for exact neighbours that pass most cells over.

Each large class has a few pivots, drawn by hash. A vector lies in the cell of its nearest pivot, and a
cell knows its least and greatest distance to it. By the triangle inequality no vector of a cell is nearer to a query
than ``d - greatest`` or ``least - d``, ``d`` being the query's distance to the pivot; so a query
visits only cells whose bound is within its reach: a fixed one, or that of the k-th neighbour found in the
nearest cells. Similarities are dot products of vectors of length one at most, for which a similarity of
``s`` or more needs a distance of ``sqrt(2 - 2 s)`` or less.

Pivots and cells are bounded in number, MOST of all classes together, so tasks hold them all; classes
beyond that, and small ones, are one cell each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pivots of all classes together, and of one, at most; rows that a pivot must be worth.
MOST, OF_CLASS, WORTH = 4096, 32, 256
EPSILON, SLACK = 1e-8, 1e-7


def unit_rows(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / (np.sqrt((x * x).sum(axis=1, keepdims=True)) + EPSILON)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)))


def reach(similarity) -> np.ndarray:
    """The distance that a similarity of so much or more can have at most."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.asarray(similarity, dtype=np.float64))) + SLACK


@dataclass
class Index:
    """Pivots by class, and of each one's cell the number of vectors, the least and the greatest distance."""

    pivots: dict[str, np.ndarray]
    cells: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]

    def bounds(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to the pivots, and least possible ones to each cell's vectors (infinite of an empty cell)."""
        d, (n, low, high) = distances(x, self.pivots[name]), self.cells[name]
        return d, np.where(n > 0, np.maximum(0.0, np.maximum(d - high, low - d)), np.inf)

    def first(self, name: str, x: np.ndarray, k: int) -> np.ndarray:
        """The cells that each query looks at first: those of the least bounds, until they hold ``k`` vectors."""
        d, b = self.bounds(name, x)
        order = np.lexsort((d, b), axis=1)
        before = np.cumsum(self.cells[name][0][order], axis=1) - self.cells[name][0][order]
        out = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out & np.isfinite(b)

    def packs(self, name: str, most: int) -> np.ndarray:
        """A pack's number for each cell: cells in a chain of near pivots, until a pack would hold more than ``most`` vectors."""
        d, n = distances(self.pivots[name], self.pivots[name]), self.cells[name][0]
        out, rest, cell, held, pack = np.zeros(len(n), dtype=np.int64), set(range(len(n))), 0, 0, 0
        while rest:
            rest.remove(cell)
            if held and held + n[cell] > most:
                held, pack = 0, pack + 1
            held, out[cell] = held + n[cell], pack
            cell = min(rest, key=lambda c: (d[cell, c], c), default=0)
        return out


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name_", F.to_json(F.struct("class_")))


def placed(rows: DataFrame, pivots: dict[str, np.ndarray]) -> DataFrame:
    """``rows`` (id, class_, v) with the cell of the nearest pivot, and how far it is; cell 0 of a class without pivots."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cell, away = np.zeros(len(frame), dtype=np.int32), np.zeros(len(frame))
            for name, at in frame.groupby("name_").indices.items():
                if (p := pivots.get(name)) is not None:
                    d = distances(unit_rows(frame["v"].iloc[at]), p)
                    cell[at], away[at] = d.argmin(axis=1), d.min(axis=1)
            yield frame.assign(cell=cell, away=away)

    return named(rows.select("id", "class_", "v")).mapInPandas(put, f"id {kinds['id']}, class_ {kinds['class_']}, v {kinds['v']}, name_ string, cell int, away double")


def index(rows: DataFrame) -> tuple[Index, DataFrame]:
    """The index of ``rows`` (id, class_, v), and the rows with their cells."""
    sizes = named(rows.select("class_")).groupBy("name_").agg(F.count(F.lit(1)).alias("n")).where(F.col("name_").isNotNull() & (F.col("n") >= 2 * WORTH))
    sizes = sizes.orderBy(F.desc("n"), "name_").limit(MOST // 2).collect()
    if not sizes:
        return Index({}, {}), named(rows).withColumns({"cell": F.lit(0), "away": F.lit(0.0)})
    many = {r.name_: min(OF_CLASS, r.n // WORTH, max(2, MOST // len(sizes))) for r in sizes}
    step = rows.sparkSession.createDataFrame([(r.name_, -(-r.n // many[r.name_])) for r in sizes], "name_ string, step long")
    drawn = named(rows).join(F.broadcast(step), "name_").where(F.pmod(F.xxhash64("id"), "step") == 0).select("name_", "id", "v").collect()
    vectors: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: r.id):
        if len(own := vectors.setdefault(r.name_, [])) < 2 * many[r.name_]:
            own.append(list(r.v))
    pivots = {name: unit_rows(pd.Series(v)) for name, v in vectors.items()}
    laid = placed(rows, pivots)
    held = laid.where(F.col("name_").isin(list(pivots))).groupBy("name_", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()
    cells = {name: (np.zeros(len(p), dtype=np.int64), np.full(len(p), np.inf), np.zeros(len(p))) for name, p in pivots.items()}
    for r in held:
        n, low, high = cells[r.name_]
        n[r.cell], low[r.cell], high[r.cell] = r.n, r.low, r.high
    return Index(pivots, cells), laid


def visits(queries: DataFrame, known: Index, choose, wants: str | None = None) -> DataFrame:
    """``queries`` (id, class_, v) for each cell that they visit: (id, class_, v, cell).

    ``choose`` (index, class name, unit vectors, the column ``wants``) gives a row of booleans, by cell, for each
    query. Of a class without pivots all visit cell 0, unless ``wants`` is given.
    """
    kinds = {f.name: f.dataType.simpleString() for f in queries.schema}

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, at in frame.groupby("name_").indices.items():
                part = frame.iloc[at]
                if name in known.pivots:
                    who, cell = choose(known, name, unit_rows(part["v"]), part[wants].to_numpy() if wants else None).nonzero()
                    yield part.iloc[who][["id", "class_", "v"]].assign(cell=cell.astype(np.int32))
                elif wants is None:
                    yield part[["id", "class_", "v"]].assign(cell=np.int32(0))

    some = named(queries.select("id", "class_", "v", *([wants] if wants else [])))
    return some.mapInPandas(go, f"id {kinds['id']}, class_ {kinds['class_']}, v {kinds['v']}, cell int")


def any_of(cells: np.ndarray, packs: np.ndarray) -> np.ndarray:
    """Booleans by cell to booleans by pack."""
    return np.stack([cells[:, packs == k].any(axis=1) for k in range(packs.max() + 1)], axis=1)


def packed(laid: DataFrame, packs: dict[str, np.ndarray]) -> DataFrame:
    """Rows of an index (id, class_, v, cell) with the pack for the cell."""
    table = laid.sparkSession.createDataFrame([(name, c, int(k)) for name, own in packs.items() for c, k in enumerate(own)], "name_ string, cell int, pack int")
    return laid.join(F.broadcast(table), ["name_", "cell"], "left").select("id", "class_", "v", F.coalesce("pack", F.lit(0)).alias("cell"))


def by_cell(rows: DataFrame) -> DataFrame:
    """Rows with a cell as rows whose class is class and cell."""
    return rows.select("id", F.struct("class_", "cell").alias("class_"), "v")
