"""Most similar vectors of every vector by an inverted multi-index.

Vectors are cut in two halves, and each half is quantised by its own codebook of K centroids; a
vector's cell is its pair of centroids, so K squared cells cost two small codebooks.  A query visits
cells in the order of summed distance, taken from a heap over the two sorted centroid lists, until
enough entries lie in them, and the entries of the visited cells are reranked by exact cosine.

Codebooks are fitted on a bounded sample, every vector is indexed.  K grows with the square root of
the number of vectors, so entries per cell and work per vector stay the same.  Cells are shipped in
blocks: those of one first centroid together, so that a query that visits several of them travels
once; small ones share a block with their neighbours, and one with more rows than a block may hold
is split by second centroid.  A cell that holds too many rows is divided again by codebooks fitted on its own part of the sample.  Groups of
exact copies are represented by their first ``k + 1`` ids, and the other copies get their result
from these without meeting each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut, spread

#: Vectors in the sample that the codebooks are fitted on: this many times the root of all, within bounds.
FIT_SHARE = 24
FIT_POINTS = 6_000
MOST_FIT_POINTS = 24_000
FIT_ROUNDS = 8
#: Centroids of one half at most, which bounds the index by four million cells of 16 bytes.
MOST_CENTROIDS = 2_048
#: Rows that visit blocks and meet in one task, about.
TASK_ROWS = 100_000
#: Entries a query wants to see, by the sample's estimate, cells it visits at least and at most, at least in the index of a full cell, and centroids of each half it looks at.
WANTED = 40
LEAST_CELLS = 3
MOST_CELLS = 16
INNER_CELLS = 8
LISTED = 6
#: Rows of one block at most, at least and as a share of all, and of one cell, by the sample's estimate; a fuller cell gets an index of its own.
BLOCK_ROWS = 20_000
LEAST_BLOCK = 1_000
BLOCK_SHARE = 32
CELL_ROWS = 2_500
LEAST_SAMPLE = 48
DEEPEST = 4
#: Exact copies from which a group is represented by its first ids, and groups whose first ids are broadcast; more are joined by shuffle.
MANY_COPIES = 64
BROADCAST_GROUPS = 10_000


@dataclass
class MultiIndex:
    """Codebooks of both halves, expected entries per cell, each cell's number and block, indexes of full cells."""

    first: np.ndarray
    second: np.ndarray
    expected: np.ndarray
    number: np.ndarray
    block: np.ndarray
    inner: dict[tuple[int, int], MultiIndex]

    def distances(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = points.shape[1] // 2
        out = []
        for part, book in ((points[:, :half], self.first), (points[:, half:], self.second)):
            out.append((book**2).sum(axis=1)[None, :] - 2 * part @ book.T)
        return out[0], out[1]

    def visits(self, points: np.ndarray, least: int = LEAST_CELLS) -> list[list[tuple[int, int]]]:
        """(block, number) of the cells of each point in the order of summed distance; its own cell comes first."""
        block, number = self.block.tolist(), self.number.tolist()
        walks = self.walks(points, least)
        if not self.inner:
            return [[(block[i][j], number[i][j]) for i, j in walk] for walk in walks]
        deeper: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for cell, index in self.inner.items():
            asking = [at for at, walk in enumerate(walks) if cell in walk]
            deeper[cell] = dict(zip(asking, index.visits(points[asking], INNER_CELLS), strict=True)) if asking else {}
        return [[leaf for i, j in walk for leaf in (deeper[i, j][at] if (i, j) in deeper else [(block[i][j], number[i][j])])] for at, walk in enumerate(walks)]

    def walks(self, points: np.ndarray, least: int = LEAST_CELLS) -> list[list[tuple[int, int]]]:
        """Centroid pairs of each point in the order of summed distance."""
        one, two = self.distances(points)
        listed = min(LISTED, one.shape[1], two.shape[1])
        order1, order2 = _nearest(one, listed), _nearest(two, listed)
        near1, near2 = np.take_along_axis(one, order1, 1).tolist(), np.take_along_axis(two, order2, 1).tolist()
        expected = self.expected
        out = []
        for o1, o2, d1, d2 in zip(order1.tolist(), order2.tolist(), near1, near2, strict=True):
            heap = [(d1[0] + d2[0], 0, 0)]
            cells: list[tuple[int, int]] = []
            seen = 0.0
            while heap and len(cells) < MOST_CELLS and (seen < WANTED or len(cells) < least):
                _, i, j = heapq.heappop(heap)
                cell = (o1[i], o2[j])
                cells.append(cell)
                seen += expected[cell]
                # Each cell is reached once: down its column, and along the first row.
                if j + 1 < listed:
                    heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
                if j == 0 and i + 1 < listed:
                    heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
            out.append(cells)
        return out


def _nearest(distances: np.ndarray, count: int) -> np.ndarray:
    part = np.argpartition(distances, count - 1, axis=1)[:, :count] if count < distances.shape[1] else np.tile(np.arange(distances.shape[1]), (len(distances), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(distances, part, 1), axis=1, kind="stable"), 1)


def _codebook(points: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centroids by k-means; a centroid that loses all points keeps its place."""
    rng = np.random.default_rng(seed)
    book = points[rng.choice(len(points), min(count, len(points)), replace=False)].copy()
    for _ in range(FIT_ROUNDS):
        nearest = ((book**2).sum(axis=1)[None, :] - 2 * points @ book.T).argmin(axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(book))
        filled = counts > 0
        book[filled] = sums[filled] / counts[filled, None]
    return book


def fit_index(sample: np.ndarray, total: float) -> MultiIndex:
    """Codebooks of a sample of normalised vectors for ``total`` vectors in all."""
    most = float(np.clip(total / BLOCK_SHARE, LEAST_BLOCK, BLOCK_ROWS))
    return _fit(sample, total, _Numbering(most), 0)


@dataclass
class _Numbering:
    """Numbers of cells and blocks as an index and those of its full cells are laid out."""

    most: float
    cell: int = 0
    block: int = 0
    held: float = 0.0

    def place(self, rows: float) -> int:
        """Block of the next cell: the same one until it is full."""
        if self.held and self.held + rows > self.most:
            self.block, self.held = self.block + 1, 0.0
        self.held += rows
        return self.block


def _fit(sample: np.ndarray, total: float, numbering: _Numbering, depth: int) -> MultiIndex:
    half = sample.shape[1] // 2
    count = int(np.clip(round(np.sqrt(max(total, 1)) / 5), 1, min(MOST_CENTROIDS, max(1, len(sample) // 8))))
    first, second = _codebook(sample[:, :half], count, 1), _codebook(sample[:, half:], count, 2)
    # Centroids in the order of their main direction, so that neighbours come to share a block.
    first = first[np.argsort((first - first.mean(axis=0)) @ np.linalg.svd(first - first.mean(axis=0), full_matrices=False)[2][0], kind="stable")]
    shape = (len(first), len(second))
    numbers = np.arange(numbering.cell, numbering.cell + shape[0] * shape[1], dtype=np.int32).reshape(shape)
    numbering.cell += numbers.size
    index = MultiIndex(first, second, np.zeros(shape), numbers, np.zeros(shape, np.int32), {})
    one, two = (d.argmin(axis=1) for d in index.distances(sample))
    np.add.at(index.expected, (one, two), total / max(1, len(sample)))
    for row in range(shape[0]):
        # A first centroid isn't divided while it fits into one block.
        rows = index.expected[row].sum()
        if numbering.held and rows <= numbering.most < numbering.held + rows:
            numbering.block, numbering.held = numbering.block + 1, 0.0
        for column in range(shape[1]):
            rows = index.expected[row, column]
            if rows > CELL_ROWS and depth < DEEPEST and count > 1:
                inside = sample[(one == row) & (two == column)]
                if len(inside) >= LEAST_SAMPLE:
                    index.inner[row, column] = _fit(inside, rows, numbering, depth + 1)
                    continue
            index.block[row, column] = numbering.place(rows)
    return index


def usable(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the vectors with ``size`` finite numbers that aren't all zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.nonzero(lengths == size)[0]
    if not len(rows):
        return rows, np.zeros((0, size), np.float32)
    # Numbers that are null come out as NaN.
    values = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, size)
    good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
    return rows[good], values[good]


def unit(values: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that no square overflows or vanishes."""
    scaled = values.astype(np.float64) / np.abs(values).max(axis=1, keepdims=True)
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def packed(values: np.ndarray) -> list[bytes]:
    """Each vector as bytes, of half precision where that loses nothing."""
    with np.errstate(over="ignore"):
        small = values.astype(np.float16)
    exact = (small.astype(np.float32) == values).all(axis=1)
    return [s.tobytes() if e else v.tobytes() for s, v, e in zip(small, values, exact, strict=True)]


def unpacked(cells: list[bytes], size: int) -> np.ndarray:
    out = np.empty((len(cells), size), np.float32)
    for row, cell in enumerate(cells):
        out[row] = np.frombuffer(cell, np.float16 if len(cell) == 2 * size else np.float32)
    return out


def _routed(points: DataFrame, index: MultiIndex, size: int) -> DataFrame:
    """A row for each point and block it visits: block, id, vector, own (its cell there, or -1), visited cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                rows, values = usable(batch.column(1), size)
                ids = batch.column(0).to_pylist()
                blocks, keys, vectors, owns, cells = [], [], [], [], []
                if len(rows):
                    for row, cell, visited in zip(rows.tolist(), packed(values), index.visits(unit(values)), strict=True):
                        if ids[row] is None:
                            continue
                        by: dict[int, list[int]] = {}
                        for block, number in visited:
                            by.setdefault(block, []).append(number)
                        own = visited[0][1]
                        for block, inside in by.items():
                            blocks.append(block)
                            keys.append(ids[row])
                            vectors.append(cell)
                            owns.append(own if own in inside else -1)
                            cells.append(inside)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int32()), pa.array(keys, pa.string()), pa.array(vectors, pa.binary()), pa.array(owns, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                    names=["block", "id", "vector", "own", "visited"],
                )

    return spread(points).mapInArrow(run, "block int, id string, vector binary, own int, visited array<int>")


def _reranked(routed: DataFrame, size: int, k: int, least: float, tasks: int = 0) -> DataFrame:
    """The ``k`` best other points of each point among the entries of the cells it visits in a block.

    ``tasks`` is the number of tasks that blocks are spread over; 0 leaves it to the session.
    """

    def run(table: pa.Table) -> pa.Table:
        names, codes = np.unique(np.array(table.column("id").to_pylist(), dtype=object).astype(str), return_inverse=True)
        # A point that was delivered twice with one vector is one point.
        _, keep = np.unique(np.stack([codes, table.column("own").to_numpy()]), axis=1, return_index=True)
        table, codes = table.take(pa.array(keep)), codes[keep]
        vectors = unit(unpacked(table.column("vector").to_pylist(), size))
        own = table.column("own").to_numpy()
        visited = table.column("visited").combine_chunks()
        if isinstance(visited, pa.ChunkedArray):
            visited = visited.chunk(0)
        asker = np.repeat(np.arange(len(codes)), visited.value_lengths().to_numpy(zero_copy_only=False))
        cells = visited.flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        asker, cells = asker[order], cells[order]
        entries = np.argsort(own, kind="stable")
        owns = own[entries]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cell in np.unique(owns[owns >= 0]):
            held = entries[np.searchsorted(owns, cell) : np.searchsorted(owns, cell, "right")]
            asking = asker[np.searchsorted(cells, cell) : np.searchsorted(cells, cell, "right")]
            # Slices bound the matrix of one cell.
            step = max(1, 4_000_000 // len(held))
            for start in range(0, len(asking), step):
                part = asking[start : start + step]
                cosine = vectors[part] @ vectors[held].T
                cosine[codes[part][:, None] == codes[held][None, :]] = -2
                if len(held) > k:
                    # The k-th best and all that equal it; ties are cut by id below.
                    bound = np.partition(cosine, -k, axis=1)[:, -k]
                    good = (cosine >= bound[:, None]) & (cosine >= max(least, -1.0))
                else:
                    good = cosine >= max(least, -1.0)
                at, to = np.nonzero(good)
                found.append((part[at], held[to], cosine[at, to]))
        if found:
            asks, holds, cosines = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((codes[holds], -cosines, codes[asks]))
            asks, holds, cosines = codes[asks][order], codes[holds][order], cosines[order]
            fresh = np.ones(len(asks), bool)
            fresh[1:] = asks[1:] != asks[:-1]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(asks)), 0))
            top = np.arange(len(asks)) - first < k
            asks, holds, cosines = asks[top], holds[top], cosines[top]
        else:
            asks, holds, cosines = np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32)
        return pa.table({"id": pa.array(names[asks].tolist(), pa.string()), "other": pa.array(names[holds].tolist(), pa.string()), "similarity": pa.array(cosines.astype(np.float32), pa.float32())})

    return (routed.repartition(tasks, "block") if tasks else routed).groupBy("block").applyInArrow(run, "id string, other string, similarity float")


def most_similar(points: DataFrame, k: int = 5, size: int = 384, least: float = -1.0, id_column: str = "id", vector_column: str = "vector") -> DataFrame:
    """id, other, rank, similarity: the ``k`` most similar other points of every point, by cosine.

    Points with null id, or whose vector hasn't ``size`` finite numbers or is all zero, take no part.
    A point delivered several times is one point.  Ties go to the smaller id.  Neighbours below
    ``least`` are left out.  An empty table gives no rows.
    """
    narrow = points.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast("array<float>").alias("vector")).where(
        F.col("id").isNotNull() & (F.size("vector") == size)
    )
    total = narrow.count()
    out = "id string, other string, rank int, similarity float"
    if not total:
        return points.sparkSession.createDataFrame([], out)
    wanted = int(np.clip(FIT_SHARE * np.sqrt(total), FIT_POINTS, MOST_FIT_POINTS))
    share = min(1.0, wanted / total)
    drawn = narrow.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= int(1_000_003 * share)).select("vector").limit(2 * wanted).toArrow()
    _, sample = usable(drawn.column(0), size)
    if not len(sample):
        _, sample = usable(narrow.select("vector").limit(wanted).toArrow().column(0), size)
    if not len(sample):
        sample = np.eye(1, size, dtype=np.float32)
    index = fit_index(unit(sample), total)

    # Groups of many exact copies, by two hashes of the vector; their ids beyond the first k + 1 stay out of the index.
    marked = narrow.select("id", F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b")).alias("copy"))
    crowds = marked.groupBy("copy").agg(F.count("id").alias("rows")).where(F.col("rows") >= MANY_COPIES).select("copy")
    groups = len(crowds.limit(BROADCAST_GROUPS + 1).toArrow())
    if not groups:
        inside, aside = narrow, None
    else:
        few = groups <= BROADCAST_GROUPS
        sound = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        copy = F.struct(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
        ranked = narrow.withColumn("copy", copy).join(F.broadcast(crowds) if few else crowds, "copy").where(sound).select("id", "copy").distinct()
        # First ids of a crowd: of each of many parts, then of these, so that no task sees a whole crowd.
        part = Window.partitionBy("copy", F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
        early = ranked.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
        early = early.withColumn("n", F.row_number().over(Window.partitionBy("copy").orderBy("id"))).where(F.col("n") <= k + 1)
        heads = cut(early.groupBy("copy").agg(F.array_sort(F.collect_list("id")).alias("heads")))
        small = F.broadcast(heads) if few else heads
        outside = F.coalesce(~F.array_contains("heads", F.col("id")), F.lit(False))
        members = ranked.join(small, "copy").where(outside)
        aside = members.select("id", F.posexplode(F.slice("heads", 1, k)).alias("at", "other")).select(
            "id", "other", (F.col("at") + 1).alias("rank"), F.lit(1.0).cast("float").alias("similarity")
        )
        inside = narrow.withColumn("copy", copy).join(small, "copy", "left").where(~outside).select("id", "vector")
    # A point visits about two blocks.  Many points need more tasks than the session's shuffles have; else adaptive execution settles them.
    tasks = 2 * total // TASK_ROWS
    tasks = tasks if tasks > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
    near = _reranked(_routed(inside, index, size), size, k, least, tasks)
    # One exchange by id serves both the merging of what a point found in several blocks and the ranking.
    near = near.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    best = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    result = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("id", "other", "rank", "similarity")
    return result if aside is None else result.unionByName(aside)


def similar_pairs(points: DataFrame, k: int = 5, least: float = 0.8, size: int = 384) -> DataFrame:
    """id_a, id_b (id_a before id_b) of pairs at least ``least`` similar of which one is among the other's ``k`` best."""
    near = most_similar(points, k, size, least)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).where("id_a < id_b").distinct()
