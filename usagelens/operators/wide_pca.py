"""Principal components of a sparse matrix with too many columns for a covariance matrix.

Block Lanczos with full reorthogonalisation: the space spanned by a block of b vectors and its images under
ZᵀZ, with Z the centred matrix, soon holds the leading components; they come from the small matrix of ZᵀZ in
that space. Z itself is never formed: ZᵀZ·V is Xᵀ(X·V) less rows·center·(center·V).

The matrix is cut into tiles of bounded size, users by items, one Spark row each. A block of vectors is
a row per item tile, so each product is a join of tiles with vector blocks and a sum of small arrays. The
driver sees inner products only: b numbers per vector found so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelens.session import materialize

USER_TILE = 4096
ITEM_TILE = 1024
_BLOCK = "tile int, v binary"


def _array(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(rows, -1)


def _as_batch(tiles: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), pa.array([x.tobytes() for x in arrays], pa.binary())],
                                      ["tile", "v"])


def _mapped(df: DataFrame, step: Callable[[dict], np.ndarray]) -> DataFrame:
    """(tile, v) from rows that hold a tile and arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _as_batch([row["tile"]], [step(row)])
    return df.mapInArrow(run, _BLOCK)


def _inner(df: DataFrame, step: Callable[[dict], np.ndarray]) -> np.ndarray:
    """The sum over rows of a small array, summed per task before the driver sees it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                part = step(row)
                total = part if total is None else total + part
        if total is not None:
            yield _as_batch([0], [total])
    found = [np.frombuffer(row["v"], np.float64) for row in df.mapInArrow(run, _BLOCK).toLocalIterator()]
    return np.sum(found, axis=0)


class _Tiles:
    """The matrix in tiles: `cells(user_id, item_code, scaled)` and `columns(item, item_code, center)`."""

    def __init__(self, cells: DataFrame, columns: DataFrame):
        self.columns, self.width = columns, columns.count()
        # A plain function, since it travels to the tasks.
        self.rows = lambda tile, width=self.width: min(ITEM_TILE, width - tile * ITEM_TILE)
        people = cells.select("user_id").distinct()
        self.height = people.count()
        parts = -(-self.height // USER_TILE) or 1
        rank = F.row_number().over(Window.partitionBy("ut").orderBy("user_id")) - 1  # about USER_TILE users each
        self.users = materialize(people.withColumn("ut", F.pmod(F.xxhash64("user_id"), F.lit(parts)).cast("int"))
                                 .withColumn("u", rank.cast("int")))
        self.sizes = self.users.groupBy("ut").agg(F.max("u").alias("top"))
        item = F.col("item_code").cast("int")
        placed = (cells.where(F.col("item_code").isNotNull() & (F.col("scaled") != 0)).join(self.users, "user_id")
                  .select("ut", "u", F.floor(item / ITEM_TILE).cast("int").alias("it"), (item % ITEM_TILE).alias("i"), "scaled"))
        self.tiles = materialize(placed.groupBy("ut", "it").agg(F.collect_list("u").alias("u"), F.collect_list("i").alias("i"),
                                                                F.collect_list("scaled").alias("x"))
                                 .join(self.sizes, "ut"))
        self.center = materialize(_mapped(
            columns.select(F.floor(F.col("item_code") / ITEM_TILE).cast("int").alias("tile"),
                           F.struct((F.col("item_code") % ITEM_TILE).cast("int").alias("i"), "center").alias("c"))
            .groupBy("tile").agg(F.sort_array(F.collect_list("c")).alias("c")),
            lambda row: np.array([c["center"] for c in row["c"]])))

    def project(self, block: DataFrame) -> DataFrame:
        """X·V per user tile."""
        rows = self.rows

        def part(row: dict) -> np.ndarray:
            v, x = _array(row["v"], rows(row["it"])), np.array(row["x"])
            taken, u = v[np.array(row["i"])] * x[:, None], np.array(row["u"])
            return np.stack([np.bincount(u, taken[:, k], row["top"] + 1) for k in range(v.shape[1])], 1)

        joined = self.tiles.join(block.withColumnRenamed("tile", "it"), "it").withColumn("tile", F.col("ut"))
        return self._summed(_mapped(joined, part))

    def back(self, scores: DataFrame) -> DataFrame:
        """Xᵀ·Y per item tile."""
        rows = self.rows

        def part(row: dict) -> np.ndarray:
            y, x = _array(row["v"], row["top"] + 1), np.array(row["x"])
            taken, i = y[np.array(row["u"])] * x[:, None], np.array(row["i"])
            return np.stack([np.bincount(i, taken[:, k], rows(row["it"])) for k in range(y.shape[1])], 1)

        joined = self.tiles.join(scores.withColumnRenamed("tile", "ut"), "ut").withColumn("tile", F.col("it"))
        return self._summed(_mapped(joined, part))

    @staticmethod
    def _summed(parts: DataFrame) -> DataFrame:
        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(v.as_py(), np.float64) for v in table["v"])
            return pa.Table.from_batches([_as_batch([table["tile"][0].as_py()], [total])])

        # A group holds one small array per tile that meets it.
        return parts.groupBy("tile").applyInArrow(add, _BLOCK)


def _start(tiles: _Tiles, b: int) -> DataFrame:
    rows = tiles.rows
    return _mapped(tiles.center, lambda row: np.random.default_rng(row["tile"]).standard_normal((rows(row["tile"]), b)))


def _orthonormal(squares: np.ndarray, floor: float) -> np.ndarray:
    """Weights that make vectors with these inner products orthonormal; directions below `floor` are left out."""
    values, turns = np.linalg.eigh((squares + squares.T) / 2)
    kept = values > floor
    return turns[:, kept] / np.sqrt(values[kept])


def _krylov(tiles: _Tiles, k: int, b: int, tolerance: float, max_rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Blocks (tile, v) of an orthonormal basis, and the weights of the k leading components in it."""
    rows, height = tiles.rows, tiles.height
    start = materialize(_start(tiles, b))
    squares = _inner(start, lambda row: (lambda v: v.T @ v)(_array(row["v"], rows(row["tile"])))).reshape(b, b)
    turn = _orthonormal(squares, 1e-12 * np.trace(squares))
    basis = materialize(_mapped(start, lambda row: _array(row["v"], rows(row["tile"])) @ turn))
    last, small, size = turn.shape[1], np.zeros((0, 0)), turn.shape[1]
    for _ in range(max_rounds):
        new = last
        block = _mapped(basis, lambda row, n=new: np.ascontiguousarray(_array(row["v"], rows(row["tile"]))[:, -n:]))
        image = materialize(tiles.back(materialize(tiles.project(block))))
        held = image.withColumnRenamed("v", "w").join(basis, "tile", "right").join(
            tiles.center.withColumnRenamed("v", "c"), "tile")

        def of(row: dict, n: int = new) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            v, c = _array(row["v"], rows(row["tile"])), _array(row["c"], rows(row["tile"]))
            return v, np.zeros((len(v), n)) if row["w"] is None else _array(row["w"], len(v)), c

        # center·V, then the parts of the image within the basis, twice for full orthogonality.
        shift = _inner(held, lambda row: (lambda v, w, c: c.T @ v[:, -w.shape[1]:])(*of(row))).reshape(1, new)
        centered = lambda v, w, c: w - height * c * shift
        inside = np.zeros((size, new))
        for _ in range(2):
            def products(row: dict) -> np.ndarray:
                v, w, c = of(row)
                w = centered(v, w, c) - v @ inside
                return np.concatenate([v.T @ w, w.T @ w])
            found = _inner(held, products).reshape(size + new, new)
            inside = inside + found[:size]
        # The small matrix is symmetric; the newest block's column says all that is new.
        grown = np.zeros((size, size))
        grown[:len(small), :len(small)] = small
        grown[:, -new:] = inside
        grown[-new:, :] = inside.T
        small = (grown + grown.T) / 2
        values, turns = np.linalg.eigh(small)
        leading = turns[:, ::-1][:, :k]
        left = found[size:] - found[:size].T @ found[:size]
        missed = np.sqrt(np.maximum(np.diag(leading[-new:].T @ left @ leading[-new:]), 0))
        turn = _orthonormal(left, 1e-22 * max(values[-1], 0.0) ** 2)
        if turn.shape[1] == 0 or (size >= k and np.all(missed <= tolerance * values[-1])):
            return basis, leading

        def widened(row: dict) -> np.ndarray:
            v, w, c = of(row)
            return np.concatenate([v, (centered(v, w, c) - v @ inside) @ turn], axis=1)
        basis = materialize(_mapped(held, widened))
        last, size = turn.shape[1], size + turn.shape[1]
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _loadings(tiles: _Tiles, k: int, oversample: int, tolerance: float, max_rounds: int) -> DataFrame:
    basis, leading = _krylov(tiles, k, min(k + oversample, tiles.width), tolerance, max_rounds)
    rows = tiles.rows
    padded = np.pad(leading, ((0, 0), (0, k - leading.shape[1])))
    return materialize(_mapped(basis, lambda row: _array(row["v"], rows(row["tile"])) @ padded))


def wide_components(cells: DataFrame, columns: DataFrame, k: int = 2, oversample: int = 14, tolerance: float = 1e-10,
                    max_rounds: int = 20) -> DataFrame:
    """Loadings (item, center, v0..) of the first k components.

    `cells`: user_id, item_code, scaled; `columns`: item, item_code, center, with codes from 0 without gaps. Each
    round reads the cells twice. Fails if the components still move after `max_rounds`; a component the
    data does not have is 0.
    """
    tiles = _Tiles(cells, columns)
    rows = tiles.rows

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                v = _array(row["v"], rows(row["tile"]))
                yield pa.RecordBatch.from_arrays([pa.array(row["tile"] * ITEM_TILE + np.arange(len(v)), pa.int64()),
                                                  pa.array(v.tolist(), pa.list_(pa.float64()))], ["item_code", "v"])

    found = _loadings(tiles, k, oversample, tolerance, max_rounds).mapInArrow(listed, "item_code long, v array<double>")
    return columns.join(found, "item_code").select("item", "center", *[F.col("v")[j].alias(f"v{j}") for j in range(k)])


def wide_projection(cells: DataFrame, columns: DataFrame, k: int = 2, oversample: int = 14, tolerance: float = 1e-10,
                    max_rounds: int = 20) -> DataFrame:
    """Users on the first k components; signs make the largest loading positive. Options as for `wide_components`."""
    tiles = _Tiles(cells, columns)
    if tiles.width == 0:
        return tiles.users.select("user_id", *[F.lit(0.0).alias(f"pca{j + 1}") for j in range(k)])
    rows, loadings = tiles.rows, _loadings(tiles, k, oversample, tolerance, max_rounds)
    extremes = np.array([_array(row["v"], 2) for row in _mapped(loadings, lambda row: (
        lambda v: np.stack([v.max(axis=0), v.min(axis=0)]))(_array(row["v"], rows(row["tile"])))).toLocalIterator()])
    signs = np.where(extremes[:, 0].max(axis=0) >= -extremes[:, 1].min(axis=0), 1.0, -1.0)
    shift = _inner(loadings.join(tiles.center.withColumnRenamed("v", "c"), "tile"), lambda row: (
        _array(row["c"], rows(row["tile"])).T @ _array(row["v"], rows(row["tile"])))).reshape(k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y = np.frombuffer(row["v"], np.float64).reshape(-1, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), row["tile"], np.int32)), pa.array(np.arange(len(y), dtype=np.int32)),
                                                  pa.array(y.tolist(), pa.list_(pa.float64()))], ["ut", "u", "y"])

    # Users without any cell in the columns stand where the centre puts them.
    places = tiles.project(loadings).mapInArrow(listed, "ut int, u int, y array<double>")
    return tiles.users.join(places, ["ut", "u"], "left").select("user_id", *[
        ((F.coalesce(F.col("y")[j], F.lit(0.0)) - float(shift[j])) * float(signs[j])).alias(f"pca{j + 1}") for j in range(k)])
