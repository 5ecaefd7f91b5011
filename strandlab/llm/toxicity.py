"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are lower-case words and their beginnings of four to seven letters (so a
stem is found in a word never seen before). Of these the index keeps the terms
that three examples have and whose presence depends on the label (chi-square of
``least_chi2`` or more), all of them, which makes the cosine speak about toxicity
instead of topic. Weights are
(1 + ln tf) * (1 + ln((1 + N) / (1 + df))), vectors have unit length.

The index is a posting list for each term, cut by blocks of examples; each piece
knows its largest weight. A query bounds every block by the sum over its terms, opens blocks by
falling bound and stops when the k-th best cosine found reaches the next bound:
the k nearest are exact. Texts without any kept term are nearest (cosine 1) to
all examples without any.

Votes are weighted by cosine and by class (the examples are drawn evenly from
both classes, the votes restore the classes' share among all labelled rows), and
calibrated by a logistic curve fitted on the examples themselves, each scored
without itself. The evidence of a score is the list of the nearest ids, their
cosines and labels.

Fitting takes at most ``per_class`` labelled documents of each class (smallest
hashes of the ids) and of those only texts of up to ``MAX_FIT_BYTES`` bytes. Scoring
reads every row and whole texts.

Edge cases: null or empty text has no terms; a null id is never held out;
without usable labels of both classes all rows score 0.5; ties of cosine go to
the smaller id; null labels are ignored; repeated rows are each scored, alike; an
empty table gives an empty result; the score replaces an input column of its name,
all other columns are kept.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import crc_mod, release_memory, table
from strandlab.llm.quality import labelled_sample

MAX_FIT_BYTES = 20_000
STEMS = (4, 5, 6, 7)
MEMO = 400_000
_words = re.compile(r"\w+")


def _terms_of(chunk: str) -> tuple[str, ...]:
    """Terms of what stands between two white spaces."""
    out = []
    for w in _words.findall(chunk):
        out.append(w)
        out.extend(f"{w[:n]}*" for n in STEMS if len(w) > n)
    return tuple(out)


def term_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for chunk, n in Counter((text or "").lower().split()).items():
        for t in _terms_of(chunk):
            counts[t] += n
    return counts


def runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


@dataclass
class ExampleIndex:
    """Unit vectors of the labelled examples as posting lists by term, inside a term by block with the block's largest weight."""

    terms: dict[str, int]
    idf: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]  # terms and weights of each example
    ids: np.ndarray
    labels: np.ndarray
    votes: np.ndarray  # weight of an example's vote by its class
    k: int = 15
    block: int = 64
    curve: tuple[float, float] = (0.0, 1.0)
    bare: np.ndarray = field(default=None)  # examples without terms
    heads: frozenset = frozenset()  # how the terms begin: most words end here

    def __post_init__(self):
        size = np.array([len(at) for at, _ in self.vectors], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(at for at, _ in self.vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in self.vectors)])
        example = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((example, term))
        term, self._example, self._weight = term[order], example[order], weight[order]
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (self._example[1:] // self.block != self._example[:-1] // self.block)
        at = np.flatnonzero(first)
        self._block = self._example[at] // self.block
        self._block_max = np.maximum.reduceat(self._weight, at) if len(at) else self._weight
        self._postings = np.append(at, len(term))
        self._blocks_of = np.searchsorted(term[at], np.arange(len(self.terms) + 1))
        self.bare = np.flatnonzero(size == 0)
        self.heads = frozenset(t.rstrip("*")[: STEMS[0]] for t in self.terms)

    def _known(self, chunk: str) -> tuple[int, ...]:
        if not chunk.isalpha():
            return tuple(i for t in _terms_of(chunk) if (i := self.terms.get(t)) is not None)
        if chunk[: STEMS[0]] not in self.heads:
            return ()
        return tuple(i for t in _terms_of(chunk) if (i := self.terms.get(t)) is not None)

    def vector(self, text: str | None, memo: dict) -> tuple[np.ndarray, np.ndarray]:
        tf: dict[int, int] = {}
        for chunk, n in Counter((text or "").lower().split()).items():
            known = memo.get(chunk)
            if known is None:
                if len(memo) >= MEMO:
                    memo.clear()
                known = memo[chunk] = self._known(chunk)
            for i in known:
                tf[i] = tf.get(i, 0) + n
        at = np.array(sorted(tf), dtype=np.int64)
        w = (1 + np.log([tf[i] for i in at])) * self.idf[at] if len(at) else np.zeros(0)
        return at, w / np.sqrt((w * w).sum()) if len(at) else w

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and cosines of the k nearest examples, exactly (without terms: all examples without any)."""
        if not len(at):
            return self.bare, np.ones(len(self.bare))
        lists = runs(self._blocks_of[at], self._blocks_of[at + 1] - self._blocks_of[at])
        of = np.repeat(w, self._blocks_of[at + 1] - self._blocks_of[at])
        block = self._block[lists]
        n = len(self.ids)
        bounds = np.bincount(block, of * self._block_max[lists], -(-n // self.block))
        order = np.argsort(-bounds, kind="stable")
        found, cosines, step, done = np.zeros(0, np.int64), np.zeros(0), 4, 0
        while done < len(order) and bounds[order[done]] > 0:
            if len(found) >= k and cosines[k - 1] > bounds[order[done]] + 1e-6:
                break
            now = np.zeros(len(bounds), bool)
            now[order[done : done + step]] = True
            opened = np.flatnonzero(now[block])
            start = self._postings[lists[opened]]
            size = self._postings[lists[opened] + 1] - start
            here = runs(start, size)
            c = np.bincount(self._example[here], np.repeat(of[opened], size) * self._weight[here], n)
            pos = np.flatnonzero(c)
            found, cosines = np.concatenate([found, pos]), np.concatenate([cosines, c[pos]])
            top = np.lexsort((self.ids[found], -np.round(cosines, 6)))[:k]
            found, cosines = found[top], cosines[top]
            done, step = done + step, step * 2
        return found, cosines

    def vote(self, pos: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the votes of the nearest, with one vote held back for the classes' share."""
        share = np.bincount(self.labels, weights=self.votes, minlength=2)
        share = share / share.sum()
        own = self.votes[pos] * cosines**2
        toxic = own[self.labels[pos] == 1].sum() + share[1] * 0.5
        clean = own[self.labels[pos] == 0].sum() + share[0] * 0.5
        return float(np.log(toxic / clean))

    def log_odds(self, text: str | None, memo: dict) -> tuple[float, np.ndarray, np.ndarray]:
        pos, cosines = self.nearest(*self.vector(text, memo), self.k)
        return self.vote(pos, cosines), pos, cosines

    def probability(self, z) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * np.asarray(z), -30, 30)))


def distinct_examples(rows: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Drops near copies of earlier examples (3 of 8 equal min-hashes of five words): one text copied often is one example."""
    seen: set = set()
    kept = []
    for row in rows:
        w = row[1].split()
        h = np.array([zlib.crc32(" ".join(w[i : i + 5]).encode()) for i in range(max(1, len(w) - 4))], np.uint64)
        keys = [(i, int(((h * np.uint64(m)) >> np.uint64(16) & np.uint64(0xFFFFFFFF)).min())) for i, m in enumerate(range(0x9E3779B1, 0x9E3779B1 + 16 * 0x1234567, 2 * 0x1234567))]
        if sum(k in seen for k in keys) < 3:
            kept.append(row)
            seen.update(keys)
    return kept


def fit_examples(rows: list[tuple[int, str, int]], share: float | None = None, k: int = 15, least_chi2: float = 12.0) -> ExampleIndex | None:
    """``share``: the toxic share among all labelled rows; None: that of ``rows``."""
    rows = distinct_examples(rows)
    labels = np.array([y for _, _, y in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        return None
    counts = [term_counts(t) for _, t, _ in rows]
    df = (Counter(), Counter())
    for c, y in zip(counts, labels):
        df[y].update(c.keys())
    n0, n1 = (labels == 0).sum(), (labels == 1).sum()
    names = sorted(t for t in df[0].keys() | df[1].keys() if df[0][t] + df[1][t] >= 3)
    b, a = (np.array([df[y][t] for t in names], float) for y in (0, 1))
    chi2 = (a * (n0 - b) - b * (n1 - a)) ** 2 * len(rows) / np.maximum((a + b) * (n0 + n1 - a - b) * float(n0) * n1, 1e-9)
    kept = np.flatnonzero(chi2 >= least_chi2)
    terms = {names[i]: j for j, i in enumerate(kept)}
    idf = 1 + np.log((1 + len(rows)) / (1 + (a + b)[kept]))
    share = float(labels.mean()) if share is None else share
    votes = np.where(labels == 1, share / n1, (1 - share) / n0) * len(rows)
    vectors = []
    for c in counts:
        at = sorted((terms[t], n) for t, n in c.items() if t in terms)
        i = np.array([x for x, _ in at], np.int64)
        v = (1 + np.log([n for _, n in at])) * idf[i] if at else np.zeros(0)
        vectors.append((i, v / np.sqrt((v * v).sum()) if at else v))
    index = ExampleIndex(terms, idf, vectors, np.array([r[0] for r in rows]), labels, votes, k)
    index.curve = _calibrate(index)
    return index


def _calibrate(index: ExampleIndex) -> tuple[float, float]:
    """A logistic curve over the votes each example gets from the others."""
    z = np.zeros(len(index.labels))
    for j in range(len(z)):
        pos, cosines = index.nearest(*index.vectors[j], index.k + 1)
        other = pos != j
        z[j] = index.vote(pos[other], cosines[other])
    y, u = index.labels.astype(float), index.votes
    w = np.zeros(2)
    x = np.column_stack([np.ones(len(z)), z])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (u * p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (u * (y - p)) - 0.1 * (w - [0, 1]))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 1500) -> ExampleIndex | None:
    rows = labelled_sample(docs, labels, label, per_class, MAX_FIT_BYTES)
    n = labels.where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit_examples(rows, n)


def score_toxicity(docs: DataFrame, index: ExampleIndex | None, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column: score, evidence (ids, cosines and labels of the nearest)."""
    kind = "score double, evidence array<struct<id: bigint, cosine: double, label: int>>"
    if index is None:
        return docs.withColumn(out_col, F.struct(F.lit(0.5).alias("score"), F.array().cast("array<struct<id: bigint, cosine: double, label: int>>").alias("evidence")))
    shared = docs.sparkSession.sparkContext.broadcast(index)  # at most 2 * per_class examples of at most MAX_FIT_BYTES each

    @F.pandas_udf(kind)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ix, memo = shared.value, {}
        bare = ix.log_odds("", {})
        for texts in batches:
            z, evidence = np.zeros(len(texts)), []
            for i, text in enumerate(texts):
                at, w = ix.vector(text, memo)
                if len(at):
                    pos, cosines = ix.nearest(at, w, ix.k)
                    z[i] = ix.vote(pos, cosines)
                else:
                    z[i], pos, cosines = bare
                evidence.append([{"id": int(ix.ids[p]), "cosine": float(c), "label": int(ix.labels[p])} for p, c in zip(pos[: ix.k], cosines[: ix.k])])
            yield pd.DataFrame({"score": ix.probability(z), "evidence": evidence})
        memo.clear()
        release_memory()

    return docs.withColumn(out_col, scored(F.col(f"`{text_col}`")))


def op8_nearest_toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held)
    scored = score_toxicity(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), F.col("toxicity.score").alias("score"), F.col("toxicity.evidence").alias("evidence"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence")
