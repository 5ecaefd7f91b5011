"""Near duplicates: BagMinHash signatures, banding, exact multiset verification, classes.

Two texts are linked when the multisets of their word five-grams have a weighted
Jaccard similarity (sum of minima over sum of maxima) of at least 0.8; classes
are the connected components of the links.

1. Each text becomes a sketch: a key of its words (texts with the same words are
   one node from here on), the packed five-gram hashes and ``BANDS`` band keys of
   ``ROWS`` BagMinHash values. At similarity 0.8 a pair shares no band with
   probability 1e-6.
2. In every shared bucket the node that meets most others is the anchor; all
   members are compared with it. One large family of copies thus costs one
   comparison each, not one for each pair.
3. Links verified so far give components. Where a bucket still holds several,
   its members are compared across components, so no link between classes is
   lost. A node that meets at most ``MEETS`` others in such buckets is compared
   with each. Nodes in a crowd (many variants of one text, unlike enough to have
   few links and like enough to share buckets) are paired by an exact prefix
   filter on five-grams: the rarest of the crowd first, a pair at or above the
   threshold shares one near both beginnings. Nodes that meet many even so
   (texts filled from one template share their rarest five-grams with others) are
   dense: pairs of two dense nodes come from keys of 10 to 22 components of a
   longer signature, level by level until a node meets few, where that thins them out. Pairs first pass two
   tests that linked pairs meet: size ratio and agreement of signature bits.
4. Verification counts the common five-grams of both whole texts.

Five-grams are compared by 40-bit hashes. Words are runs of letters, digits and
underscores in lower case; a text without such words uses its white-space
separated strings; a text of less than five words is one gram of all of them.

Edge cases: null and empty texts form one class of their own; a null id sorts
last; repeated rows are copies; ties go to the smallest id, then to the first
row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import drop_by_id, drop_numbered, few_ids, free, ids_are_unique, numbered, release_memory, staged, table
from strandlab.llm.bagminhash import band_keys, mix, sign_bits, signatures, subset_keys

GRAM, ROWS, BANDS = 5, 6, 48
M = ROWS * BANDS
BITS = 256
SLICE, SLICE_TEXTS = 50_000, 500  # five-grams and texts that are signed at once
MEMO = 50_000
MEETS = 64  # members of mixed buckets that a node may meet before it counts as crowded
DENSE = 128  # heads of others that the heads of a crowded node may meet before it counts as dense
DENSE_MEETS = 64
DENSE_M = 1024  # components of the signature of dense nodes
DENSE_LEVELS = ((10, 146), (14, 428), (18, 1208), (22, 3735))  # components in a key, keys: 1e-6 are missed at similarity 0.8
_words = re.compile(r"\w+")
_mixers = mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)

SKETCH = "rid bigint, id bigint, tkey binary, n int, grams binary, bands array<bigint>, bits array<bigint>"


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return _words.findall(text) or text.split()


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def gram_hashes(tokens: list[str], memo: dict) -> np.ndarray:
    """Sorted 40-bit hashes of the five-grams, with repetitions."""
    h = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
    n = max(0, len(h) - GRAM + 1)
    if n:
        g = sum((h[k : k + n] * _mixers[k] for k in range(1, GRAM)), h[:n] * _mixers[0])
    elif len(h):
        g = np.array([np.sum(h * _mixers[: len(h)], dtype=np.uint64)])
    else:
        g = np.zeros(0, np.uint64)
    g = mix(g) >> np.uint64(24)
    g.sort()
    return g


def packed_grams(grams: np.ndarray) -> bytes:
    return grams.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()


def unpacked_grams(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    out = np.zeros((len(part), 8), np.uint8)
    out[:, 3:] = part
    return out.reshape(-1).view(">u8").astype(np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """``docs``: (rid, id, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            held, size = [], 0
            rid, ids, texts = (batch.column(c) for c in ("rid", "id", "text"))
            for i in range(batch.num_rows):
                tokens = words_of(texts[i].as_py())
                grams = gram_hashes(tokens, memo)
                held.append((rid[i].as_py(), ids[i].as_py(), xxhash.xxh3_128_digest("\x1f".join(tokens)), grams))
                size += len(grams)
                if size >= SLICE or len(held) >= SLICE_TEXTS:
                    yield _signed(held)
                    held, size = [], 0
            if held:
                yield _signed(held)
        memo.clear()
        release_memory()

    return docs.mapInArrow(sign, SKETCH)


def _signed(held: list[tuple]) -> pa.RecordBatch:
    n = np.array([len(h[3]) for h in held], np.int64)
    grams = np.concatenate([h[3] for h in held])
    owner = np.repeat(np.arange(len(held)), n)
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(grams)))
    sig = signatures(owner[at], grams[at], weight, len(held), M)

    def lists(rows: np.ndarray) -> pa.Array:
        offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()))

    columns = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary()), pa.array(n, pa.int32()), pa.array([packed_grams(h[3]) for h in held], pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, lists(band_keys(sig, ROWS)), lists(sign_bits(sig, BITS // 64))], names=["rid", "id", "tkey", "n", "grams", "bands", "bits"])


def multiset_similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed sorted multisets."""
    x, y = unpacked_grams(a), unpacked_grams(b)
    if not len(x) and not len(y):
        return 1.0
    # Numbering repetitions turns common members into common pairs (value, occurrence).
    both, nth = np.concatenate([x, y]), np.concatenate([_occurrence(x), _occurrence(y)])
    order = np.lexsort((nth, both))
    v, k = both[order], nth[order]
    common = int(((v[1:] == v[:-1]) & (k[1:] == k[:-1])).sum())
    return common / (len(both) - common)


def _occurrence(sorted_values: np.ndarray) -> np.ndarray:
    start = np.ones(len(sorted_values), bool)
    start[1:] = sorted_values[1:] != sorted_values[:-1]
    at = np.flatnonzero(start)
    return np.arange(len(sorted_values)) - np.repeat(at, np.diff(np.append(at, len(sorted_values))))


def _numbered(sorted_values: np.ndarray) -> np.ndarray:
    """40-bit values with the number of their repetition in the lower 24 bits: a multiset as a sorted set."""
    return (sorted_values << np.uint64(24)) | np.minimum(_occurrence(sorted_values), 2**24 - 1).astype(np.uint64)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each connected component of ``edges`` (a, b).

    Smallest labels spread along the edges and labels jump to their label's
    label; a round is one written table, and stars take two rounds.
    """
    e = staged(edges.selectExpr("a as u", "b as v").unionByName(edges.selectExpr("b as u", "a as v")), "edges")
    label = last = staged(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")), "label")
    while True:
        near = e.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        better = staged(label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")), "better")
        jump = better.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = staged(better.join(jump, "comp", "left").select("node", "old", F.coalesce("further", "comp").alias("comp")), "jumped")
        label = new.select("node", "comp")
        done = new.where("old <> comp").isEmpty()
        free(better, last)
        last = new
        if done:
            free(e)
            return label


def _verified(pairs: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at or above the threshold, materialised as ``pairs`` are; nodes are row ids."""
    ids = staged(pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct(), "ids")
    grams = staged(sketch.select("rid", "grams").join(few_ids(ids), "rid", "left_semi"), "grams")
    left = pairs.join(grams.select(F.col("rid").alias("a"), F.col("grams").alias("ga")), "a")
    both = left.join(grams.select(F.col("rid").alias("b"), F.col("grams").alias("gb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ga, gb = batch.column("ga"), batch.column("gb")
            s = np.array([multiset_similarity(ga[i].as_py(), gb[i].as_py()) for i in range(batch.num_rows)], float)
            kept = pa.array(s >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept), pa.array(s).filter(kept)], names=["a", "b", "similarity"])
        release_memory()

    found = staged(both.select("a", "b", "ga", "gb").mapInArrow(compare, "a bigint, b bigint, similarity double"), "verified")
    free(ids, grams)
    return found


def _rarest(crowd: DataFrame, threshold: float) -> DataFrame:
    """Materialised (node, comp, n, bits, e, pos): the members of each multiset that any linked one must share, rarest first.

    ``crowd``: (node, comp, n, bits, grams), materialised. Members are put into one
    order, by the number of multisets that hold them; two of n and m members with
    a similarity of t share at least t / (1 + t) * (n + m), hence one at most at
    positions (n - m + s) / 2 + 1 and (m - n + s) / 2 + 1 of each, where
    s = (1 - t) / (1 + t) * (n + m). Members that a single multiset holds only
    move the others on.
    """

    def numbered_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_numbered(unpacked_grams(g.as_py())).view(np.int64) for g in batch.column("grams")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(lists, pa.list_(pa.int64()))], names=["node", "es"])

    lists = staged(crowd.select("node", "grams").mapInArrow(numbered_grams, "node bigint, es array<bigint>"), "members")
    each = lists.select("node", F.explode("es").alias("e"))
    common = staged(each.groupBy("e").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    held = each.join(common, "e").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("held"))
    rows = crowd.select("node", "comp", "n", "bits").join(held, "node").withColumn("alone", F.col("n") - F.size("held"))
    most = F.floor(F.col("n") * (1 - threshold) + 1e-6).cast("int") + 1
    rows = rows.withColumn("held", F.slice("held", F.lit(1), F.greatest(most - F.col("alone"), F.lit(0))))
    rows = rows.select("node", "comp", "n", "bits", "alone", F.posexplode("held").alias("at", "h"))
    rows = staged(rows.select("node", "comp", "n", "bits", F.col("h.e").alias("e"), (F.col("alone") + F.col("at") + 1).alias("pos")), "rarest")
    free(lists, common)
    return rows


def _crowd_pairs(crowd: DataFrame, threshold: float) -> list[DataFrame]:
    """Materialised pairs (a, b) of the crowd, of different components, that may be linked.

    Of a linked pair one has a shared member within its first (1 - t) / (1 + t) * n + 1
    (a head). Heads of one component, size and position stand as one row in the
    join, so a family of copies meets its surroundings once, not copy by copy.
    Nodes whose heads meet more than ``DENSE`` heads of others are dense; pairs of two of them that ``_dense_pairs`` settles come from there.
    """
    k = (1 - threshold) / (1 + threshold)
    rarest = _rarest(crowd, threshold)
    rows = rarest.withColumn("head", F.col("pos") <= k * F.col("n") + 1 + 1e-6)
    held = rows.groupBy("e", "comp").agg(F.sum(F.col("head").cast("int")).alias("heads_own"))
    every = held.groupBy("e").agg(F.sum("heads_own").alias("heads_all"), F.count(F.lit(1)).alias("comps"))
    every = staged(every.where("comps > 1 and heads_all > 0").drop("comps"), "keys")
    # Texts of one length must share a head of both: what a node's heads meet is what the join below would look at.
    cost = rows.where("head").join(every, "e").join(held, ["e", "comp"]).groupBy("node").agg(F.sum(F.col("heads_all") - F.col("heads_own")).alias("meets"))
    dense = staged(cost.where(F.col("meets") > DENSE).select("node"), "dense")
    found, settled = _dense_pairs(staged(crowd.select("node", "comp", "n", "grams", "others").join(few_ids(dense), "node"), "dense_grams"), threshold)
    shared = rows.join(every.select("e"), "e", "left_semi").join(settled.withColumn("dense", F.lit(True)), "node", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    shared = staged(shared, "shared")
    heads = shared.where("head")
    kinds = heads.groupBy("e", "comp", "n", "pos", "dense").agg(F.count(F.lit(1)).alias("heads"))
    kinds = kinds.select("e", F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("dense").alias("dense_a"))
    other = shared.select("e", F.col("node").alias("b"), F.col("comp").alias("comp_b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("bits").alias("bits_b"), F.col("dense").alias("dense_b"))
    spare = k * (F.col("n_a") + F.col("n_b")) + 2 + 1e-6
    early = (2 * F.col("pos_a") <= F.col("n_a") - F.col("n_b") + spare) & (2 * F.col("pos_b") <= F.col("n_b") - F.col("n_a") + spare)
    # One of the two isn't dense: the dense stand on one side only of each join.
    met = kinds.where("not dense_a").join(other, "e").unionByName(kinds.where("dense_a").join(other.where("not dense_b"), "e"))
    met = staged(met.where((F.col("comp_a") != F.col("comp_b")) & _sizes(threshold) & early), "met")
    own = heads.select("e", F.col("comp").alias("comp_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("dense").alias("dense_a"), F.col("node").alias("a"), F.col("bits").alias("bits_a"))
    pairs = met.join(own, ["e", "comp_a", "n_a", "pos_a", "dense_a"]).where(_agree(threshold))
    found.append(staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "crowd_pairs"))
    free(rarest, every, shared, met, dense, settled)
    return found


def _subsets(rows: int, count: int) -> np.ndarray:
    """``count`` subsets of ``rows`` of the ``DENSE_M`` components, the same on every machine."""
    draws = mix(np.arange(count * DENSE_M, dtype=np.uint64) + mix(np.full(1, rows, np.uint64))).reshape(count, DENSE_M)
    return np.argpartition(draws, rows, axis=1)[:, :rows]


def _deep_sketches(nodes: DataFrame, rows: int, count: int) -> DataFrame:
    """(node, comp, n, keys, bits): keys of subsets of a longer signature, and a bit of each component."""
    subsets = _subsets(rows, count)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                held.append((i, unpacked_grams(batch.column("grams")[i].as_py())))
                size += len(held[-1][1])
                if size >= SLICE or len(held) >= SLICE_TEXTS // 8 or i == batch.num_rows - 1:
                    yield _deep(batch, held, subsets)
                    held, size = [], 0
        release_memory()

    return nodes.mapInArrow(sign, "node bigint, comp bigint, n int, keys array<bigint>, bits array<bigint>")


def _deep(batch: pa.RecordBatch, held: list[tuple], subsets: np.ndarray) -> pa.RecordBatch:
    owner, element, weight = [], [], []
    for k, (_, grams) in enumerate(held):
        values, counts = np.unique(grams, return_counts=True)
        owner.append(np.full(len(values), k))
        element.append(mix(values + np.uint64(1)))  # apart from the shorter signature
        weight.append(counts)
    sig = signatures(np.concatenate(owner), np.concatenate(element), np.concatenate(weight), len(held), DENSE_M)
    lists = lambda rows: pa.array(list(rows.view(np.int64)), pa.list_(pa.int64()))
    at = pa.array([i for i, _ in held])
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "comp", "n")), lists(subset_keys(sig, subsets)), lists(sign_bits(sig, DENSE_M // 64))], names=["node", "comp", "n", "keys", "bits"])


def _dense_pairs(nodes: DataFrame, threshold: float) -> tuple[list[DataFrame], DataFrame]:
    """``nodes``: (node, comp, n, grams, others: met in the buckets so far), materialised.

    Materialised pairs of dense nodes from buckets of more and more components, and the nodes whose pairs with each other are all among them.

    A level's keys miss a pair at similarity 0.8 with probability 1e-6. A node that
    meets few others in its level's buckets (``DENSE_MEETS`` and a third of the keys at
    most, a near neighbour counting as often as it is met) is compared with each and is settled; the others go on to the next level, as long as they meet at
    most three fifths of what they met before (unlinked texts of one template do). Nodes
    that don't thin out, or aren't settled in the end, go back to the rarest
    five-grams: their surroundings lie just below the threshold, where exact positions tell more.
    """
    found, settled = [], []
    before = nodes.select("node", F.col("others").alias("meets"))
    for level, (rows, count) in enumerate(DENSE_LEVELS):
        if nodes.isEmpty():
            break
        deep = staged(_deep_sketches(nodes, rows, count), "deep")
        keyed = deep.select(F.explode("keys").alias("key"), "node", "comp")
        held = keyed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own"))
        every = held.groupBy("key").agg(F.sum("own").alias("every"), F.count(F.lit(1)).alias("comps")).where("comps > 1").drop("comps")
        others = held.join(every, "key").select("key", "comp", (F.col("every") - F.col("own")).alias("meets"))
        inside = staged(keyed.join(others, ["key", "comp"]).select("key", "node", "comp", "meets"), "deep_inside")
        meets = inside.groupBy("node").agg(F.sum("meets").alias("meets"))
        meets = staged(nodes.select("node").join(meets, "node", "left").na.fill(0, ["meets"]), "deep_meets")
        most = DENSE_MEETS + count // 3  # a near neighbour is met in up to a third of the keys
        on = meets.where(F.col("meets") > most)
        members = inside.select("key", "node", "comp").join(on.select("node", F.lit(True).alias("on")), "node", "left").withColumn("on", F.coalesce("on", F.lit(False)))
        left = members.where("not on").selectExpr("key", "node as a", "comp as comp_a")
        right = members.selectExpr("key", "node as b", "comp as comp_b", "on")
        met = left.join(right, "key").where((F.col("comp_a") != F.col("comp_b")) & (F.col("on") | (F.col("a") < F.col("b")))).select("a", "b").distinct()
        met = staged(met, "deep_met")
        side = lambda s: deep.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        pairs = met.join(side("a"), "a").join(side("b"), "b").where(_agree(threshold, DENSE_M))
        found.append(staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "deep_pairs"))
        settled.append(staged(meets.where(F.col("meets") <= most).select("node"), "settled"))
        # Who doesn't thin out leaves here.
        on = on.join(before.withColumnRenamed("meets", "was"), "node").where(5 * F.col("meets") <= 3 * F.col("was"))
        going = staged(nodes.join(few_ids(staged(on.select("node"), "deep_on")), "node"), "dense_grams")
        free(deep, inside, met, nodes, *([before] if level else []))
        before, nodes = meets, going
    everyone = reduce(lambda x, y: x.unionByName(y), settled) if settled else nodes.select("node")
    return found, staged(everyone, "settled")


def _sizes(threshold: float):
    return F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")


def _agree(threshold: float, bits: int = BITS):
    """Tests that linked pairs meet: sizes exactly, the bits but for 1e-9 (six deviations)."""
    p = (1 + threshold) / 2
    least = int(bits * p - 6 * (bits * p * (1 - p)) ** 0.5)
    same = bits - sum((F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(bits // 64)), F.lit(0))
    return _sizes(threshold) & (same >= least)


def near_classes(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", rid_col: str | None = None) -> DataFrame:
    """One row per row: doc_id, class_id (smallest id of the class), class_size, kept, node, rid (``rid_col`` where given: a unique bigint)."""
    number = F.monotonically_increasing_id() if rid_col is None else F.col(rid_col)
    sketch = staged(sketches(docs.select(number.alias("rid"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))), "sketch")
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "rid")
    nodes = sketch.groupBy("tkey").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("copies"), F.min(first).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    nodes = staged(nodes, "nodes")
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))

    banded = nodes.where("n > 0").select("node", F.explode("bands").alias("key"))
    shared = staged(banded.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "shared")
    members = staged(banded.join(shared, "key"), "members")
    degree = members.groupBy("node").agg(F.sum("met").alias("degree"))
    anchors = members.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("best"))
    anchors = staged(anchors.select("key", (-F.col("best.minus")).alias("b")), "anchors")
    pairs = members.select("key", F.col("node").alias("a")).join(anchors, "key").where("a <> b").select("a", "b").distinct()
    pairs = staged(pairs.join(side("a"), "a").join(side("b"), "b").where(_agree(threshold)).select("a", "b"), "pairs")
    links = _verified(pairs, sketch, threshold)
    label = components(links)

    # Buckets that still hold several components.
    labelled = members.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    mixed = staged(mixed, "mixed")
    inside = staged(labelled.join(mixed, "key"), "inside")

    # Who meets few others there is compared with all of them ...
    met = inside.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    own = inside.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("own")).join(met, "key")
    crowded = inside.join(own, ["key", "comp"]).groupBy("node").agg((F.sum("met") > MEETS).alias("crowded"), F.sum(F.col("met") - F.col("own")).alias("others"))
    around = staged(inside.select("key", "node", "comp").join(crowded, "node").join(nodes.select("node", "n", "bits"), "node"), "around")
    left = around.where("not crowded").selectExpr("key", "node as a", "comp as comp_a", "n as n_a", "bits as bits_a")
    right = around.selectExpr("key as key_b", "node as b", "comp as comp_b", "n as n_b", "bits as bits_b", "crowded")
    rest = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("comp_a") != F.col("comp_b")) & (F.col("crowded") | (F.col("a") < F.col("b"))) & _agree(threshold))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    # ... those in a crowd with whom shares one of their rarest five-grams.
    who = staged(around.where("crowded").select("node", "comp", "n", "bits", "others").distinct(), "crowd")
    crowd = staged(sketch.select(F.col("rid").alias("node"), "grams").join(few_ids(who), "node"), "crowd")
    if not crowd.isEmpty():
        for more in _crowd_pairs(crowd, threshold):
            rest = rest.unionByName(more)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = staged(rest.distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    found = [links.select("a", "b")]
    if not rest.isEmpty():
        found.append(_verified(rest, sketch, threshold).select("a", "b"))
    if len(found) > 1:
        label = components(reduce(lambda x, y: x.unionByName(y), found))

    classed = nodes.select("tkey", "node", "copies", "first").join(label, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    classes = staged(classed.groupBy("comp").agg(F.min("first").alias("first"), F.sum("copies").alias("class_size")), "classes")
    by_text = staged(classed.select("tkey", "node", "comp").join(classes, "comp"), "by_text")
    free(nodes, shared, members, anchors, pairs, links, mixed, inside, around, who, crowd, rest, classes)
    out = sketch.select("rid", "id", "tkey").join(by_text, "tkey")
    out = staged(out.select(F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), "class_size", (F.col("first.rid") == F.col("rid")).alias("kept"), "node", "rid"), "classes")
    free(sketch, by_text)
    return out


def drop_near_copies(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class; where ids are null or repeated rows are told apart by number, so these take part like all others."""
    if ids_are_unique(docs):
        classes = near_classes(docs.select("doc_id", "text"), threshold, rid_col="doc_id")
        return drop_by_id(docs, staged(classes.where("not kept").select("rid"), "gone"))
    rows = numbered(docs)
    classes = near_classes(rows.select("__rid", "__row.doc_id", "__row.text"), threshold, rid_col="__rid")
    return drop_numbered(rows, staged(classes.where("not kept").select("rid"), "gone"))


def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
