"""Hard negatives by an inverted multi-index over two half-space codebooks, exact by certified windows.

1. Each half of the vectors gets a codebook, fitted on a bounded sample. A row's two codes are its cell; every row is
   indexed. Each code keeps its radius, the largest distance of a member's half from the code.
2. For an anchor q the score of any row of cell (i, j) is at most the sum of two half bounds, q1.c1[i] + |q1| r1[i] and
   q2.c2[j] + |q2| r2[j]. Codes of each half are sorted by their bound, and a heap over pairs of places (multi-sequence)
   gives the cells by falling sum.
3. Cells are visited in rungs of a growing number of rows. An anchor is done once its window is certified: it has as many
   rows as asked for and the least of them scores above the bound of the next cell, or that bound lies below the window.
   The other anchors go on to the next rung; the last holds all cells.

Rows lie on shelves of about `shelf_rows` rows in the order of cells; a cell larger than that spans several shelves.
Anchors travel in packs. A group is one shelf and a bunch of packs, so its size is bounded. Results that leave a group are
the best few rows of each anchor and window.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.session import materialise

PACK, BUNCH = 256, 64  # anchors in a pack, packs in a group


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """row, vec_id, label, dim, v: floor(scale * x) of the usable rows, each with a number of its own."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & label.isNotNull() & F.coalesce(usable, F.lit(False)))
    return materialise(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")), "vectors")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def codebook(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """Centres of Lloyd's method, begun from evenly spaced points."""
    centres = np.unique(points, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(codes, len(centres))).astype(int)]
    for _ in range(rounds):
        near = nearest(points, centres)
        size = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def cells_by_bound(first: np.ndarray, second: np.ndarray):
    """(bound, code of the first half, code of the second half) of all pairs of codes, by falling sum of their bounds."""
    one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    one, two = one.tolist(), two.tolist()
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, one[i], two[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if not j and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Index:
    """Codebooks, radii and the number of rows of each cell, by length of vector: a few thousand numbers in all."""

    def __init__(self, books: dict[int, tuple[np.ndarray, np.ndarray]], codes: int) -> None:
        self.books, self.codes = books, codes
        self.radii: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.counts: dict[int, np.ndarray] = {}

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The codebooks; a length without sampled rows has one code at zero in each half."""
        return self.books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row, and how far its halves are from their codes."""
        half, (one, two) = matrix.shape[1] // 2, self.of(matrix.shape[1])
        i, j = nearest(matrix[:, :half], one), nearest(matrix[:, half:], two)
        return (i * self.codes + j, np.linalg.norm(matrix[:, :half] - one[i], axis=1),
                np.linalg.norm(matrix[:, half:] - two[j], axis=1))

    def learn(self, dim: int, cell: np.ndarray, rows: np.ndarray, far_one: np.ndarray, far_two: np.ndarray) -> None:
        size = [len(book) for book in self.of(dim)]
        self.counts[dim] = np.zeros(self.codes ** 2, np.int64)
        self.counts[dim][cell] = rows
        self.radii[dim] = np.zeros(size[0]), np.zeros(size[1])
        np.maximum.at(self.radii[dim][0], cell // self.codes, far_one)
        np.maximum.at(self.radii[dim][1], cell % self.codes, far_two)

    def place(self, begins: list[tuple[int, int, int, int]], shelf_rows: int, part_rows: int) -> None:
        """Where the rows of each (length, cell) begin in the order of cells, and how many there are.

        `part_rows` rows of a cell are dealt together.
        """
        self.begins = {(dim, cell): (begin, n) for dim, cell, begin, n in begins}
        self.shelf_rows, self.part_rows = shelf_rows, part_rows

    def shelves(self, dim: int, cell: int) -> range:
        begin, n = self.begins[dim, cell]
        last = begin + (math.ceil(n / self.part_rows) - 1) * self.part_rows
        return range(begin // self.shelf_rows, last // self.shelf_rows + 1)

    def visit(self, query: np.ndarray, done: int, upto: int) -> tuple[list[int], float]:
        """Cells behind the first `done` rows until `upto` rows are seen, and a bound on all rows of later cells."""
        dim = len(query)
        half, (one, two), (r_one, r_two) = dim // 2, self.of(dim), self.radii[dim]
        slack = 1e-9 * (1 + float(query @ query))
        first = one @ query[:half] + np.linalg.norm(query[:half]) * r_one
        second = two @ query[half:] + np.linalg.norm(query[half:]) * r_two
        counts, seen, cells = self.counts[dim], 0, []
        slack += 1e-9 * (abs(first).max() + abs(second).max())
        for bound, i, j in cells_by_bound(first, second):
            cell = i * self.codes + j
            if not counts[cell]:
                continue
            if seen >= upto:
                return cells, bound + slack
            if seen >= done:
                cells.append(cell)
            seen += int(counts[cell])
        return cells, -math.inf


def fit(rows: DataFrame, codes: int, sample_rows: int) -> Index:
    """Codebooks from `sample_rows` rows at most, those of the smallest hash."""
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(sample_rows).select("dim", "v").toPandas()
    books = {}
    for dim, part in sample.groupby("dim"):
        matrix = np.stack(part["v"].to_list()).astype(np.float64)
        books[int(dim)] = codebook(matrix[:, :dim // 2], codes), codebook(matrix[:, dim // 2:], codes)
    return Index(books, codes)


def _build(rows: DataFrame, codes: int, sample_rows: int, shelf_rows: int, part_rows: int, most: int) -> tuple[Index, DataFrame]:
    """The index, and the shelves: dim, shelf, rows, ids, labels, cells and the matrix, all as bytes.

    Of rows with equal label and vector only the `most` of the smallest id are on a shelf: no result holds more of them.
    """
    index = fit(rows, codes, sample_rows)
    shared = rows.sparkSession.sparkContext.broadcast(index)  # codebooks of bounded size
    alike = Window.partitionBy("label", "v").orderBy("vec_id", "row")
    few = rows.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= most).drop("nth")

    def assign(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                matrix = np.stack(part["v"].to_list()).astype(np.float64)
                cell, one, two = shared.value.assign(matrix)
                yield part.assign(cell=cell, far_one=one, far_two=two)

    dealt = materialise(few.mapInPandas(assign, f"{_columns(few)}, cell long, far_one double, far_two double"), "cells")
    cells = dealt.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far_one").alias("one"), F.max("far_two").alias("two"))
    begins, begin = [], 0
    for dim, part in cells.toPandas().sort_values(["dim", "cell"]).groupby("dim"):  # at most codes squared rows for each length
        index.learn(int(dim), part["cell"].to_numpy(), part["n"].to_numpy(), part["one"].to_numpy(), part["two"].to_numpy())
        for cell, n in zip(part["cell"].tolist(), part["n"].tolist()):
            begins.append((int(dim), cell, begin, n))
            begin += n
    index.place(begins, shelf_rows, part_rows)
    places = rows.sparkSession.createDataFrame(begins, "dim int, cell long, begin long, n long")
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / part_rows))
    shelved = dealt.join(places, ["dim", "cell"]).withColumn(
        "shelf", F.floor((F.col("begin") + part * part_rows) / shelf_rows)).select("dim", "shelf", "row", "vec_id", "label", "cell", "v")

    def gather(key, frame):
        import pandas as pd

        frame = frame.sort_values(["cell", "vec_id", "row"])
        matrix = np.stack(frame["v"].to_list())
        kind = "<i4" if np.abs(matrix).max() < 1 << 31 else "<i8"
        columns = {c: [frame[c].to_numpy("<i8").tobytes()] for c in ("row", "vec_id", "label", "cell")}
        return pd.DataFrame({"dim": [int(key[0])], "shelf": [int(key[1])], **columns, "kind": [kind], "matrix": [matrix.astype(kind).tobytes()]})

    schema = "dim int, shelf long, row binary, vec_id binary, label binary, cell binary, kind string, matrix binary"
    return index, materialise(shelved.groupBy("dim", "shelf").applyInPandas(gather, schema), "shelves")


def best(scores: np.ndarray, ids: np.ndarray, usable: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best usable scores, ties to smaller ids."""
    at = np.flatnonzero(usable)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def lower_end(score: int, percent: int) -> int:
    """The least whole number of which 100 times is at least `percent` times the score."""
    return -((-percent * int(score)) // 100)


def _rung(anchors: DataFrame, shared, shelves: DataFrame, done: int, upto: int, packs: int, bunch_packs: int, k: int,
          same: bool, percent: int) -> tuple[DataFrame, DataFrame]:
    """Visits one rung: (anchor and bound of what is left), (anchor, window, vec_id, score) of the best rows met."""

    def plan(frames):
        for frame in frames:
            met = [shared.value.visit(np.asarray(v, np.float64), done, upto) for v in frame["v"]]
            yield frame.assign(cells=[np.asarray(c, np.int64) for c, _ in met], bound=[b for _, b in met])

    planned = materialise(anchors.mapInPandas(plan, f"{_columns(anchors)}, cells array<long>, bound double"), "rung")

    def pack(key, frame):
        import pandas as pd

        wanted: dict[int, dict[int, list[int]]] = {}
        for k_row, cells in enumerate(frame["cells"]):
            for cell in cells.tolist():
                for shelf in shared.value.shelves(int(key[0]), cell):
                    wanted.setdefault(shelf, {}).setdefault(cell, []).append(k_row)
        matrix = np.stack(frame["v"].to_list()).astype("<i8")
        rows, labels = frame["row"].to_numpy("<i8"), frame["label"].to_numpy("<i8")
        out = []
        for shelf, by_cell in wanted.items():
            mine = np.unique(np.concatenate([np.asarray(a) for a in by_cell.values()]))
            number = {a: n for n, a in enumerate(mine.tolist())}
            pairs = np.array([(cell, number[a]) for cell, who in by_cell.items() for a in who], "<i8")
            windows = [list(map(int, frame["windows"].iloc[a])) for a in mine]
            out.append((int(key[0]), shelf, int(key[1]) // bunch_packs, rows[mine].tobytes(), labels[mine].tobytes(),
                        matrix[mine].tobytes(), pairs.tobytes(), windows))
        return pd.DataFrame(out, columns=["dim", "shelf", "bunch", "row", "label", "matrix", "pairs", "windows"])

    asked = "dim int, shelf long, bunch long, row binary, label binary, matrix binary, pairs binary, windows array<array<long>>"
    requests = planned.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(packs))).groupBy("dim", "pack").applyInPandas(pack, asked)
    bunches = F.sequence(F.lit(0).cast("long"), F.lit((packs - 1) // bunch_packs).cast("long"))
    stored = shelves.withColumn("bunch", F.explode(bunches))
    group = ["dim", "shelf", "bunch"]

    def score(key, shelf, asking):
        import pandas as pd

        out = []
        if len(shelf) and len(asking):
            dim = int(key[0])
            row, ids, labels, cell = (np.frombuffer(shelf[c].iloc[0], "<i8") for c in ("row", "vec_id", "label", "cell"))
            matrix = np.frombuffer(shelf["matrix"].iloc[0], shelf["kind"].iloc[0]).reshape(-1, dim)
            heads = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
            span = {int(cell[a]): slice(a, b) for a, b in zip(heads, heads[1:])}
            for a_row, a_label, a_matrix, a_pairs, windows in zip(*(asking[c] for c in ("row", "label", "matrix", "pairs", "windows"))):
                query = np.frombuffer(a_matrix, "<i8").reshape(-1, dim)
                top = int(np.abs(query).max()) * int(np.abs(matrix).max()) * dim
                kind = np.float64 if top < 1 << 53 else np.int64 if top < 1 << 62 else object
                asked_cells = np.frombuffer(a_pairs, "<i8").reshape(-1, 2)
                scores = np.zeros((len(query), len(row)), np.int64)
                seen = np.zeros((len(query), len(row)), bool)
                order = np.argsort(asked_cells[:, 0], kind="stable")
                number, begins = np.unique(asked_cells[order, 0], return_index=True)
                for c, who in zip(number.tolist(), np.split(asked_cells[order, 1], begins[1:])):
                    if c in span:
                        scores[who, span[c]] = (query[who].astype(kind) @ matrix[span[c]].astype(kind).T).astype(np.int64)
                        seen[who, span[c]] = True
                for n, (own, label) in enumerate(zip(np.frombuffer(a_row, "<i8").tolist(), np.frombuffer(a_label, "<i8").tolist())):
                    mine = scores[n]
                    if same:
                        kinds = [(0, seen[n] & (labels == label) & (row != own))]
                    else:
                        others = seen[n] & (labels != label)
                        kinds = [(w, others & (mine <= p) & (mine >= lower_end(p, percent))) for w, p in enumerate(windows[n])]
                    for w, usable in kinds:
                        out += [(own, w, int(ids[at]), int(mine[at])) for at in best(mine, ids, usable, k)]
        return pd.DataFrame(out, columns=["row", "window", "vec_id", "score"])

    met = stored.groupBy(*group).cogroup(requests.groupBy(*group)).applyInPandas(score, "row long, window int, vec_id long, score long")
    return planned.drop("cells"), met


def _search(anchors: DataFrame, index: Index, shelves: DataFrame, k: int, same: bool, percent: int,
            first_rows: int, pack: int, bunch: int) -> DataFrame:
    """row, window, rank, vec_id, score: the k best of each window of each anchor, from as few rungs as certify them."""
    spark = anchors.sparkSession
    shared = spark.sparkContext.broadcast(index)
    found = spark.createDataFrame([], "row long, window int, vec_id long, score long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "vec_id")
    done, upto, left = 0, first_rows, anchors.count()
    while left:
        planned, met = _rung(anchors, shared, shelves, done, upto, math.ceil(left / pack), bunch, k, same, percent)
        ranked = found.unionByName(met).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = materialise(ranked.drop("rank"), "met")
        kth = found.groupBy("row", "window").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        # a window is certified once it is full above the bound of the next cell, or that bound lies below it
        each = planned.where(F.col("bound") > F.lit(-math.inf)).select("row", "bound", F.posexplode("windows").alias("window", "p"))
        low = F.lit(-math.inf) if same else F.ceil(F.col("p") * (percent / 100) - 1)
        each = each if same else each.where("p >= 0")  # nothing lies between a negative score and a part of it
        waits = each.join(kth, ["row", "window"], "left").where(
            ~F.coalesce((F.col("n") >= k) & (F.col("least") > F.col("bound")), F.lit(False)) & (F.col("bound") >= low))
        anchors = materialise(planned.drop("bound").join(waits.select("row").distinct(), "row", "left_semi"), "anchors")
        left = anchors.count()
        done, upto = upto, upto * 8
    return found.withColumn("rank", F.row_number().over(order).cast("int"))


def mine(vectors: DataFrame, anchors_where, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
         label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80,
         codes: int = 32, sample_rows: int = 8192, shelf_rows: int = 16_384, first_rows: int = 8192, part_rows: int = 4096,
         pack: int = PACK, bunch: int = BUNCH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the usable rows for which `anchors_where`, a condition on vec_id, holds. An anchor's positives are its best
    `positives` other rows of the same label; for each, the best `negatives` rows of another label whose score is at most
    the positive's and at least `percent` of it are returned. Scores are inner products of floor(scale * x), ties go to
    smaller ids. Rows without an id, a label or a vector, and those whose vector is empty or holds a missing or non-finite
    component, take no part. Vectors meet only those of the same length. Rows that repeat, or share an id, are rows of
    their own; an anchor's own row alone is left out of its positives. No anchors, positives or negatives give no rows.
    The codebooks are fitted on `sample_rows` rows at most; all rows are indexed, and results are exact.
    """
    rows = whole_rows(vectors, id_col, vector_col, F.col(f"`{label_col}`") if label is None else label, scale)
    index, shelves = _build(rows, codes, sample_rows, shelf_rows, part_rows, max(positives + 1, negatives))
    asked = rows.where(anchors_where).withColumn("windows", F.array(F.lit(0).cast("long")))
    friends = _search(asked.drop("vec_id"), index, shelves, positives, True, percent, first_rows, pack, bunch)
    friends = materialise(friends.select("row", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"),
                                         F.col("score").alias("positive_score")), "positives")
    windows = friends.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("w"))
    ready = rows.where(anchors_where).join(windows, "row").select("row", "label", "dim", "v", F.col("w.positive_score").alias("windows"))
    enemies = _search(materialise(ready, "anchors"), index, shelves, negatives, False, percent, first_rows, pack, bunch)
    named = enemies.select("row", (F.col("window") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = rows.where(anchors_where).select("row", F.col("vec_id").alias("anchor_id"))
    return named.join(friends, ["row", "nth"]).join(ids, "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
