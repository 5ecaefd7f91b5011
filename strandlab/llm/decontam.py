"""Benchmark decontamination: BM25 inverted index of test items with block-max WAND, then overlap checks.

The index holds the test items, cut into pieces of at most ``PIECE`` words so
that each fits whole into some passage. Every training text is cut into passages
of ``WINDOW`` words that overlap by half; every passage is a query. Impacts are
BM25 scores divided by the piece's score against itself, so one threshold fits
short and long items alike. Posting lists are kept by term and, inside a term, by
block of ``BLOCK`` pieces with the block's largest impact. Retrieval returns every
piece at or above the threshold: a passage whose words' largest impacts don't
reach it is skipped, then blocks by the sum of their maxima, then pieces by their
own sums, and only the rest is scored. Texts are read in slices of ``SLICE`` words,
so memory follows neither the length of a text nor the number of pieces.

A retrieved (text, item) pair is verified on the whole text: the shares of the
question's and of the answer's word five-grams that occur in it (shorter answers:
the answer as a whole). The item leaks when both are at least half, or when at
least 0.8 of the whole item's five-grams occur. Where the items have no answer
column, the last sentence counts as the answer.

Document frequencies, the number of pieces and their mean length are counted once
over all items, so scores don't depend on how items are dealt. Items are dealt
by row into indexes of about ``INDEX_WORDS`` words and ``SCAN_INDEXES`` indexes are
searched in one scan of the texts; what a scan broadcasts has a fixed bound
however many items there are (a single item longer than that is an index of its
own size) and is removed before the next scan. Every scan reads the texts anew.

Edge cases: null text or items without words match nothing; items with the same
words, repeated rows too, are separate items and all are reported; a null doc_id is kept; repeated
rows each report; other columns are ignored, whatever their names; no items at
all give an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import free, release_memory, staged, table

PIECE, WINDOW = 32, 64
STRIDE = WINDOW // 2
BLOCK = 8
SLICE = 64 * STRIDE  # words of a text that are searched at once
INDEX_WORDS, SCAN_INDEXES = 100_000, 8
K1, B = 1.2, 0.75
N_GRAM = 5
_words = re.compile(r"\w+")
_sentence_end = re.compile(r"(?<=[.!?])\s+|\n+")

LEAKS = "doc_id bigint, item_id bigint, passage_score double, question_overlap double, answer_overlap double, overlap double"


def words(text: str | None) -> list[str]:
    return _words.findall((text or "").lower())


def question_and_answer(text: str, answer: str | None = None) -> tuple[list[str], list[str]]:
    if answer is not None:
        return words(text), words(answer)
    parts = [p for p in _sentence_end.split(text or "") if words(p)]
    if len(parts) < 2:
        return words(text), words(text)
    return words(" ".join(parts[:-1])), words(parts[-1])


def grams(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(N_GRAM, len(tokens))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def pieces_of(text: str | None, answer: str | None) -> list[Counter]:
    """An item's words in pieces of equal length, ``PIECE`` at most."""
    whole = words(text) + (words(answer) if answer is not None else [])
    if not whole:
        return []
    size = -(-len(whole) // -(-len(whole) // PIECE))
    return [Counter(whole[k : k + size]) for k in range(0, len(whole), size)]


class _Terms(dict):
    def __missing__(self, term: str) -> int:
        return -1


@dataclass
class Statistics:
    """Of all items: pieces, their mean length, and of the terms at hand the pieces that hold them."""

    pieces: int
    mean: float
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[tuple]) -> Statistics:
        pieces = [p for _, text, answer in items for p in pieces_of(text, answer)]
        return cls(len(pieces), sum(sum(p.values()) for p in pieces) / max(1, len(pieces)), Counter(t for p in pieces for t in p))


@dataclass
class ItemIndex:
    terms: _Terms
    top: np.ndarray  # largest impact of each term; last a zero for words the index doesn't have
    term_blocks: np.ndarray  # where the blocks of each term begin, and the end
    block: np.ndarray  # of each (term, block): its number, largest impact and where its postings begin
    block_max: np.ndarray
    block_postings: np.ndarray
    piece: np.ndarray  # of each posting
    impact: np.ndarray  # share of the piece's own score
    piece_item: np.ndarray
    item_ids: list
    parts: list[tuple[set, set, set]]  # five-grams of question, answer, whole

    @classmethod
    def build(cls, items: list[tuple], of: Statistics | None = None) -> ItemIndex:
        """``items``: (item_id, text, answer or None); ``of``: what was counted over all items, where these are some."""
        of = of or Statistics.of(items)
        pieces, owner, parts, ids = [], [], [], []
        for item_id, text, answer in items:
            own = pieces_of(text, answer)
            if not own:
                continue
            q, a = question_and_answer(text, answer)
            parts.append((grams(q), grams(a), grams(words(text) + (words(answer) if answer is not None else []))))
            pieces += own
            owner += [len(ids)] * len(own)
            ids.append(item_id)
        terms = _Terms((t, i) for i, t in enumerate(sorted({t for p in pieces for t in p})))
        n = len(pieces)
        term = np.array([terms[t] for p in pieces for t in p], np.int64)
        piece = np.repeat(np.arange(n), [len(p) for p in pieces])
        tf = np.array([c for p in pieces for c in p.values()], float)
        size = np.array([sum(p.values()) for p in pieces], float)
        df = np.array([of.df[t] for t in terms], np.int64)
        norm = K1 * (1 - B + B * size / of.mean) if n else size
        impact = np.log(1 + (of.pieces - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + norm[piece])
        impact /= np.bincount(piece, impact, n)[piece]
        order = np.lexsort((piece, term))
        term, piece, impact = term[order], piece[order], impact[order]
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (piece[1:] // BLOCK != piece[:-1] // BLOCK)
        at = np.flatnonzero(first)
        block_max = np.maximum.reduceat(impact, at) if len(at) else impact
        term_blocks = np.searchsorted(term[at], np.arange(len(terms) + 1))
        top = np.append(np.maximum.reduceat(impact, np.searchsorted(term, np.arange(len(terms)))) if len(terms) else [], 0.0)
        return cls(terms, top, term_blocks, piece[at] // BLOCK, block_max, np.append(at, len(term)), piece, impact, np.array(owner, np.int64), ids, parts)

    def numbers(self, tokens: list[str]) -> np.ndarray:
        """Term numbers, -1 for words the index doesn't have."""
        return np.fromiter(map(self.terms.__getitem__, tokens), np.int64, len(tokens))

    def retrieve(self, ids: np.ndarray, threshold: float) -> dict[int, float]:
        """Items with a piece at or above the threshold in some passage, with their best score."""
        found: dict[int, float] = {}
        for k in range(0, len(ids), SLICE):
            # The slices overlap by half a passage.
            for item, score in self._slice(ids[k : k + SLICE + STRIDE], threshold).items():
                found[item] = max(found.get(item, 0.0), score)
        return found

    def _slice(self, ids: np.ndarray, threshold: float) -> dict[int, float]:
        halves = -(-len(ids) // STRIDE)
        known = ids >= 0
        # A word counts once in each half passage; one in both halves counts twice, so sums are bounds.
        pairs = np.unique((np.arange(len(ids)) // STRIDE * len(self.top) + ids)[known])
        half, term = pairs // len(self.top), pairs % len(self.top)

        def passages(rows: np.ndarray) -> np.ndarray:
            return rows[:-1] + rows[1:] if len(rows) > 1 else rows

        found: dict[int, float] = {}
        live = passages(np.bincount(half, self.top[term], halves)) >= threshold - 1e-9
        if not live.any():
            return found
        near = np.zeros(halves, bool)  # half passages of live passages
        near[: len(live)] |= live
        if halves > 1:
            near[1:] |= live
        half, term = half[near[half]], term[near[half]]
        start, count = self.term_blocks[term], self.term_blocks[term + 1] - self.term_blocks[term]
        at, of = _runs(start, count), np.repeat(half, count)
        block, blocks = self.block[at], -(-len(self.piece_item) // BLOCK)
        sums = np.bincount(of * blocks + block, self.block_max[at], halves * blocks).reshape(halves, -1)
        hit = (passages(sums) >= threshold - 1e-9).any(axis=0)
        if not hit.any():
            return found
        open_ = hit[block]
        at, of = at[open_], of[open_]
        start, count = self.block_postings[at], self.block_postings[at + 1] - self.block_postings[at]
        at, of = _runs(start, count), np.repeat(of, count)
        pieces, local = np.unique(self.piece[at], return_inverse=True)
        sums = np.bincount(of * len(pieces) + local, self.impact[at], halves * len(pieces)).reshape(halves, -1)
        for w, p in zip(*np.nonzero(passages(sums) >= threshold - 1e-9)):
            seen = set(ids[w * STRIDE : w * STRIDE + WINDOW].tolist())
            score = self._score(seen, int(pieces[p]))
            if score >= threshold - 1e-9:
                item = int(self.piece_item[pieces[p]])
                found[item] = max(found.get(item, 0.0), score)
        return found

    def _score(self, seen: set[int], piece: int) -> float:
        score = 0.0
        for t in seen - {-1}:
            lo, hi = self.term_blocks[t], self.term_blocks[t + 1]
            b = lo + np.searchsorted(self.block[lo:hi], piece // BLOCK)
            if b < hi and self.block[b] == piece // BLOCK:
                lo, hi = self.block_postings[b], self.block_postings[b + 1]
                k = lo + np.searchsorted(self.piece[lo:hi], piece)
                if k < hi and self.piece[k] == piece:
                    score += float(self.impact[k])
        return score

    def overlaps(self, item: int, text_grams) -> tuple[float, float, float]:
        return tuple(sum(g in text_grams[len(g)] for g in part) / len(part) for part in self.parts[item])


class _Grams(dict):
    """The n-grams of a text, by n, made when first asked for."""

    def __init__(self, tokens: list[str]):
        self.tokens = tokens

    def __missing__(self, n: int) -> set:
        self[n] = out = set(zip(*(self.tokens[i:] for i in range(n))))
        return out


def leaks(q: float, a: float, whole: float) -> bool:
    return (q >= 0.5 and a >= 0.5) or whole >= 0.8


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, index_words: int = INDEX_WORDS, answer_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text and leaked item: doc_id, item_id, best passage score, overlaps."""
    chosen = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("bigint").alias("item_id"), "text", (F.col(answer_col) if answer_col else F.lit(None).cast("string")).alias("answer"))
    chosen = staged(chosen, "items")
    terms = staged(chosen.mapInArrow(_pieces, "row bigint, piece int, term string, n bigint"), "terms")
    df = staged(terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    pieces = terms.groupBy("row", "piece").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n")).first()
    indexes = max(1, -(-(pieces.n or 0) // index_words))
    number = F.pmod(F.xxhash64("row"), F.lit(indexes)).cast("int")
    found = []
    for first in range(0, indexes, SCAN_INDEXES):
        # At most SCAN_INDEXES * index_words words of items are held at a time.
        here = number.between(first, first + SCAN_INDEXES - 1)
        parts: dict[int, list] = {}
        for r in sorted((tuple(r) for r in chosen.where(here).select(number.alias("index"), "row", "item_id", "text", "answer").collect()), key=lambda r: r[:2]):
            parts.setdefault(r[0], []).append(r[2:])
        own = df.join(terms.where(here).select("term").distinct(), "term")
        of = Statistics(pieces.pieces, (pieces.n or 0) / max(1, pieces.pieces), {r.term: r.df for r in own.collect()})
        shared = docs.sparkSession.sparkContext.broadcast([ItemIndex.build(p, of) for p in parts.values()])
        found.append(staged(_scan(docs, shared, threshold, id_col, text_col), "leaks"))
        shared.destroy()
    free(chosen, terms, df)
    return docs.sparkSession.read.schema(LEAKS).parquet(*(f._staged_path for f in found))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of the pieces of items, with their number of occurrences."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            for k, p in enumerate(pieces_of(batch.column("text")[i].as_py(), batch.column("answer")[i].as_py())):
                rows += [(batch.column("row")[i].as_py(), k, t, n) for t, n in p.items()]
        columns = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.int64()))], names=["row", "piece", "term", "n"])


def _scan(docs: DataFrame, shared: Broadcast, threshold: float, id_col: str, text_col: str) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("id"), batch.column("text")):
                tokens = words(text.as_py())
                own = _Grams(tokens)
                for ix in shared.value if tokens else ():
                    for item, score in ix.retrieve(ix.numbers(tokens), threshold).items():
                        q, a, whole = ix.overlaps(item, own)
                        if leaks(q, a, whole):
                            rows.append((doc_id.as_py(), ix.item_ids[item], score, q, a, whole))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.int64()] * 2 + [pa.float64()] * 4)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LEAKS.split(", ")])
        release_memory()

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, LEAKS)


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
