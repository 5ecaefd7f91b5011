"""Hard-negative mining: Fagin's threshold algorithm over per-dimension sorted lists.

Anchors are some of the rows. An anchor's positives are the ``positives`` rows of
its label with the largest integer inner products; for each positive the first
``negatives`` rows of other labels are wanted whose score lies in a window below
the positive's (``low`` to ``high`` percent of it).

Rows are written once in blocks of ``BLOCK``: ids, labels, whole-number components
and, for each dimension, the rows in the order of that component. For one anchor a
block's lists are read in the anchor's direction, from the top where its component
is positive, from the bottom where it is negative, all lists to the same depth
(sorted access). Each row met first is scored in whole numbers (random access).
The threshold is the score of a row made of the values at that depth: no row that
wasn't met scores more. Reading ends once it falls strictly below the last score
kept, or below the window's lower end, in every window still open; rows that tie
are all met. Results of blocks already read by the task keep the bar high.

Anchors are searched in groups of about ``ANCHORS`` (one broadcast of a bounded
size each, removed after use); a task gives at most its own best rows of each
window, and a window function over (anchor, positive) merges the tasks. All pairs
of an anchor with a block are looked at, as far as the threshold allows; no row is
left out. A lost executor costs the blocks it was reading.

Edge cases: rows without label, vector or vec_id, or with a component that is null
or not finite, take no part; a shorter vector counts as padded with zeros; rows of
one vec_id are each a row (and each an anchor), but never each other's positive;
equal scores go by vec_id; a positive with a score below zero has an empty window;
fewer rows than wanted are all returned; empty tables give empty results; other
columns, whatever their names, are not read. Scores are exact: where components
are too large for doubles, Python integers count, and scores beyond 64 bits are
shown as the largest 64-bit number of their sign (windows follow what is shown).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.llm._common import free, release_memory, staged, table

BLOCK = 8192  # rows of a block; lists hold 16-bit positions
ANCHORS = 4096  # anchors that are searched in one pass
FIRST_DEPTH = 32
_EXACT = 2.0**53
_LONG = 2**63 - 1


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rid, id, label, vec): whole-number components of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    rows = rows.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & x.isNotNull() & finite)
    # Spark's floor gives a long; large components must stay doubles.
    whole = F.transform(x, lambda v: _floor(v.cast("double") * 256))
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").cast("bigint").alias("label"), whole.alias("vec"))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


@dataclass
class Block:
    """Rows with their sorted lists."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray  # (rows, dims)
    order: np.ndarray  # (dims, rows), rows by rising component

    @classmethod
    def of(cls, ids: list[int], labels: list[int], vectors: list[np.ndarray]) -> Block:
        x = np.zeros((len(ids), max(map(len, vectors), default=0)))
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        return cls(np.array(ids, np.int64), np.array(labels, np.int64), x, np.argsort(x, axis=0, kind="stable").T.astype(np.uint16))

    def row(self) -> tuple:
        largest = np.abs(self.x).max() if self.x.size else 0
        kind = "i2" if largest < 2**15 else "i4" if largest < 2**31 else "f8"
        return (len(self.ids), self.ids.tobytes(), self.labels.tobytes(), kind, self.x.astype(kind).tobytes(), np.ascontiguousarray(self.order).tobytes())

    @classmethod
    def read(cls, n: int, ids: bytes, labels: bytes, kind: str, x: bytes, order: bytes) -> Block:
        part = np.frombuffer(x, kind).astype(float).reshape(n, -1)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), part, np.frombuffer(order, np.uint16).reshape(part.shape[1], n))

    def values(self) -> np.ndarray:
        """(dims, rows): each list's components."""
        return np.take_along_axis(self.x.T, self.order.astype(np.int64), axis=1)


COLUMNS = ["n", "ids", "labels", "kind", "x", "lists"]
TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary()]
BLOCKS = "n int, ids binary, labels binary, kind string, x binary, lists binary"


def sorted_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Materialised blocks of ``usable`` rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])

        def full() -> pa.RecordBatch:
            row = Block.of(*held).row()
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], names=COLUMNS)
            for h in held:
                h.clear()
            return out

        for batch in batches:
            vectors = batch.column("vec")
            for i in range(batch.num_rows):
                held[0].append(batch.column("id")[i].as_py())
                held[1].append(batch.column("label")[i].as_py())
                held[2].append(vectors[i].values.to_numpy(zero_copy_only=False))
                if len(held[0]) >= block:
                    yield full()
        if held[0]:
            yield full()
        release_memory()

    return staged(rows.select("id", "label", "vec").mapInArrow(build, BLOCKS), "lists")


class Anchor:
    """An anchor's way through the lists of one block."""

    def __init__(self, block: Block, values: np.ndarray, vector: np.ndarray) -> None:
        d = min(len(vector), block.x.shape[1])
        a = vector[:d]
        self.block, self.up, self.down = block, np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        self.values, self.vector, self.x = values, a, block.x[:, :d]
        self.n = len(block.ids)
        self.exact = bool(np.abs(a).sum() * (np.abs(self.x).max() if self.x.size else 0) >= _EXACT)
        if self.exact:
            self.vector = np.array([int(v) for v in a], object)
        self.met = np.zeros(self.n, bool)
        self.depth = 0

    def further(self) -> np.ndarray:
        """Rows met first on the way to the next depth."""
        below = min(self.n, max(FIRST_DEPTH, 3 * self.depth))
        before = self.met.copy()
        if below == self.n or not (len(self.up) or len(self.down)):
            below = self.n
            self.met[:] = True  # the lists are read to their ends
        else:
            self.met[self.block.order[self.down, self.depth : below].ravel()] = True
            self.met[self.block.order[self.up, self.n - below : self.n - self.depth].ravel()] = True
        self.depth = below
        return np.flatnonzero(self.met & ~before)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.exact:
            return self.x[rows] @ self.vector
        return np.array([sum(int(v) * w for v, w in zip(self.x[r], self.vector)) for r in rows], object)

    def threshold(self):
        """What a row that wasn't met can score at most; None once all were met."""
        if self.depth >= self.n or self.met.all():
            return None
        up, down = self.values[self.up, self.n - self.depth], self.values[self.down, self.depth - 1]
        if self.exact:
            return sum(int(v) * self.vector[d] for v, d in zip(up, self.up)) + sum(int(v) * self.vector[d] for v, d in zip(down, self.down))
        return up @ self.vector[self.up] + down @ self.vector[self.down]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first by falling score, then by id."""
    if len(scores) > 4 * k and scores.dtype != object:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= bar
        scores, ids = scores[near], ids[near]
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


@dataclass
class Wanted:
    """A window of an anchor and the best rows found for it so far."""

    key: int
    low: int | None  # scores from ... to ...; None: no bound
    high: int | None
    k: int
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, key: int, low: int | None, high: int | None, k: int) -> Wanted:
        return cls(key, low, high, k, np.zeros(0), np.zeros(0, np.int64))

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.high is not None:
            inside = (scores >= self.low) & (scores <= self.high)
        elif len(self.ids) == self.k:
            inside = scores >= self.scores[-1]
        else:
            inside = np.ones(len(scores), bool)
        if inside.any():
            self.scores, self.ids = _best(np.concatenate([self.scores, scores[inside]]), np.concatenate([self.ids, ids[inside]]), self.k)

    def open(self, threshold) -> bool:
        """Whether a row that wasn't met may belong here."""
        if self.low is not None and threshold < self.low:
            return False
        return len(self.ids) < self.k or threshold >= self.scores[-1]


@dataclass
class Sought:
    """An anchor: its vector and whether rows of its own label or of others are wanted."""

    number: int
    id: int
    label: int
    vector: np.ndarray
    same: bool
    windows: list[Wanted]


def search(block: Block, values: np.ndarray, sought: Sought) -> None:
    """The threshold algorithm on one block; the windows hold the result."""
    if not sought.windows:
        return
    way = Anchor(block, values, sought.vector)
    able = (block.labels == sought.label) & (block.ids != sought.id) if sought.same else block.labels != sought.label
    while True:
        rows = way.further()
        rows = rows[able[rows]]
        if len(rows):
            scores, ids = way.scores(rows), block.ids[rows]
            for w in sought.windows:
                w.add(scores, ids)
        threshold = way.threshold()
        if threshold is None or not any(w.open(threshold) for w in sought.windows):
            return


FOUND = "number int, window int, id bigint, score bigint"


def _searched(blocks: DataFrame, shared: Broadcast) -> DataFrame:
    """(number, window, id, score): the best rows of each task for each window of the anchors sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Sought(s.number, s.id, s.label, s.vector, s.same, [Wanted.of(w.key, w.low, w.high, w.k) for w in s.windows]) for s in shared.value]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block.read(*(batch.column(c)[i].as_py() for c in COLUMNS))
                values = block.values()
                for s in own:
                    search(block, values, s)
        rows = [(s.number, w.key, int(i), max(-_LONG, min(_LONG, int(v)))) for s in own for w in s.windows for v, i in zip(w.scores, w.ids)]
        release_memory()
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["number", "window", "id", "score"])

    return blocks.mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each window over all tasks, with their rank from 1."""
    order = Window.partitionBy("number", "window").orderBy(F.col("score").desc(), F.col("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _mined(blocks: DataFrame, own: list, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The materialised result for one group of anchors (id, label, vec)."""
    spark = blocks.sparkSession
    sought = [Sought(i, a.id, a.label, np.array(a.vec), True, [Wanted.of(0, None, None, positives)]) for i, a in enumerate(own)]
    shared = spark.sparkContext.broadcast(sought)  # about ANCHORS vectors
    best = _first(_searched(blocks, shared), positives).collect()  # positives for each of the group at most
    shared.destroy()
    for s in sought:
        s.same, s.windows = False, []
    known = []
    for r in best:
        a, least, most = sought[r.number], -(-low * r.score // 100), high * r.score // 100
        if least <= most:
            a.windows.append(Wanted.of(len(known), least, most, negatives))
            known.append((len(known), a.id, r.id, r.score))
    shared = spark.sparkContext.broadcast(sought)
    found = _first(_searched(blocks, shared), negatives)
    windows = F.broadcast(spark.createDataFrame(known, "window int, anchor_id bigint, positive_id bigint, positive_score bigint"))
    out = found.join(windows, "window").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = staged(out, "negatives")
    shared.destroy()
    return out


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block: int = BLOCK, group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: condition on (id, label); ``label``: what replaces the label, an
    expression of both; ``low``, ``high``: the window in percent of the positive's score.
    """
    spark = rows.sparkSession
    rows = usable(rows, id_col, vector_col, label_col)
    if label is not None:
        rows = rows.withColumn("label", label)
    rows = staged(rows, "usable")
    n = rows.count()
    # A block a task while there are few, else several blocks each.
    tasks = max(1, min(-(-n // block), max(4 * spark.sparkContext.defaultParallelism, n // (64 * block))))
    blocks = sorted_blocks(rows.select("id", "label", "vec").repartition(tasks), block)
    anchors = rows.where(anchor)
    groups = max(1, -(-anchors.count() // group))
    anchors = staged(anchors.withColumn("group", F.pmod(F.xxhash64("rid"), F.lit(groups))).repartition("group"), "anchors")
    parts = []
    for g in range(groups):
        # A group, of a bounded size, comes to the driver and goes out as a broadcast.
        parts.append(_mined(blocks, anchors.where(F.col("group") == g).select("id", "label", "vec").collect(), positives, negatives, low, high))
    free(rows, blocks, anchors)
    return spark.read.schema(parts[0].schema).parquet(*(p._staged_path for p in parts))


def op12_fagin_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, relabelled)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a, e r WHERE a.vec_id % 50 = 0 AND (r.label <> a.label OR r.vec_id <> a.vec_id)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
