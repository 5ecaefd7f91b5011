"""Target-distribution importance resampling over hashed word n-grams, by an Aho-Corasick dictionary.

Features of a text are its words and pairs of neighbouring words (joined by one
space), repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes
modulo ``BUCKETS``. Bucket counts of the corpus and of the target texts give each
bucket a gain (a log ratio, in thousandths, floored); a document's weight is the
floored mean of its features' gains, and a Gumbel draw from its id makes the
highest scores a sample without replacement that follows the weights.

Words are runs of digits, letters and bytes beyond ASCII after A-Z are lowered. A
text is read as bytes with one translation (letters lowered, all delimiters
spaces); a dictionary of distinct words, each bounded by a space on either side,
carries CRC and length of the word as the payload of an Aho-Corasick automaton. A
scan emits one payload for each word in reading order. The CRC of a pair follows
from the payloads alone: appending n bytes to a string is a linear map of its CRC
(tables for n = 1, 2, 4, ... are composed by the bits of n), so
crc(a + " " + b) = shift(crc(a + " "), len b) ^ crc(b); no pair is ever spelt out.

The dictionary grows with the words a task meets, slice by slice, and starts
anew beyond ``DICTIONARY`` words; a word longer than ``LONG`` bytes is replaced in
the slice by a short mark that carries its payload. Texts are scanned in slices of
``SLICE`` bytes cut at delimiters, so memory follows neither a text's length nor
the vocabulary. Counting is one pass that shuffles at most ``BUCKETS`` sums a
task; scoring is a second pass with a broadcast of ``BUCKETS`` gains. Ranks come
from sums by score, then from the order inside one score; the random draw spreads
the rows over thousands of scores.

Edge cases: a null or empty text has no feature and weight 0; a null id draws as
an empty id and comes last among equal scores; repeated rows are rows; no corpus,
no target or no rows at all are allowed; other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from strandlab.llm._common import release_memory, staged, table
from strandlab.operators.ranks import ranked

BUCKETS = 10_000
DICTIONARY = 200_000  # words of a dictionary before it starts anew
LONG = 128  # bytes of the longest word in a dictionary
SLICE = 4 << 20  # bytes that are scanned at once
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
_ASCII_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TRANSLATION = bytes(c if c in _ASCII_WORD or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_END = "Z"  # upper case doesn't occur in translated texts: the end of a text, and marks of long words
_SPACE = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _append_tables() -> np.ndarray:
    """(28, 4, 256): the map of a CRC-32 by 2**k further zero bytes, for each byte of the CRC."""
    one = np.zeros((4, 256), np.uint32)
    for byte in range(256):
        c = byte
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        one[0, byte] = c  # the low byte leaves through the table, the others move down
    for j in range(1, 4):
        one[j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1))
    tables = [one]
    while len(tables) < 28:
        tables.append(_apply(tables[-1], tables[-1]))
    return np.stack(tables)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_APPEND = _append_tables()
_AFTER_SPACE = np.uint32(zlib.crc32(b" "))


def appended(crc: np.ndarray, other: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC of a string followed by another one, from both CRCs and the other's length."""
    out, k = crc.astype(np.uint32), 0
    left = length.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _apply(_APPEND[k], out[odd])
        left >>= 1
        k += 1
    return out ^ other


def with_space(crc: np.ndarray) -> np.ndarray:
    return _apply(_APPEND[0], crc) ^ _AFTER_SPACE


def _payload(word: bytes) -> int:
    return len(word) << 32 | zlib.crc32(word)


class WordScanner:
    """Payloads of the words of many texts, by an automaton over the words met so far."""

    def __init__(self, words: int = DICTIONARY, long: int = LONG, size: int = SLICE) -> None:
        self.words, self.long, self.size = words, long, size
        self._anew()

    def _anew(self) -> None:
        self.known: set[bytes] = set()
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)  # its whole numbers have 32 bits only
        self.automaton.add_word(f" {_END} ", -1)

    def _learn(self, words: set[bytes]) -> None:
        new = words - self.known
        if not new and len(self.known):
            return
        if len(self.known) + len(new) > self.words and self.known:
            self._anew()
            new = words
        self.known |= new
        for w in new:
            # A mark spells its own payload.
            payload = int(w[1:], 16) if w[:1] == b"X" else _payload(w)
            self.automaton.add_word(f" {w.decode('latin-1')} ", payload)
        self.automaton.make_automaton()

    def scan(self, text: bytes) -> np.ndarray:
        """Payloads of the words of a translated text, -1 at each end mark."""
        words = set(text.split(b" "))
        words -= {b"", _END.encode()}
        if words and max(map(len, words)) > self.long:
            marked = lambda m: b"X%X" % _payload(m[0]) if len(m[0]) > self.long else m[0]
            text = re.sub(rb"[^ ]+", marked, text)
            words = set(text.split(b" ")) - {b"", _END.encode()}
        self._learn(words)
        # Latin-1 keeps bytes as they are; neighbouring words share the space between them.
        found = self.automaton.iter(f" {text.decode('latin-1')} ")
        return np.fromiter((payload for _, payload in found), np.int64)

    def pieces(self, texts: pa.Array) -> Iterator[tuple[bytes, int]]:
        """Translated slices with the number of texts that end in them; a text longer than a slice is cut at a delimiter."""
        held, size, ended = [], 0, 0
        for text in texts:
            raw = text.as_buffer() if text.is_valid else b""
            raw = memoryview(raw) if len(raw) else b""
            begin = 0
            while len(raw) - begin > self.size:
                # The cut: the first delimiter after a slice's length; no word is cut, however long.
                cut = _SPACE.search(raw, begin + self.size)
                if cut is None:
                    break
                held.append(bytes(raw[begin : cut.start()]).translate(_TRANSLATION))
                yield b" ".join(held), ended
                held, size, ended = [], 0, 0
                begin = cut.end()
            held += [bytes(raw[begin:]).translate(_TRANSLATION), _END.encode()]
            size += len(raw) - begin
            ended += 1
            if size >= self.size:
                yield b" ".join(held), ended
                held, size, ended = [], 0, 0
        if held:
            yield b" ".join(held), ended

    def features(self, texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the text, bucket) of all words and pairs, slice by slice."""
        at, last = 0, np.full(1, -1, np.int64)
        for text, ended in self.pieces(texts):
            payload = np.concatenate([last, self.scan(text)])
            end = payload < 0
            number = at + np.cumsum(end) - end[0]  # the first entry belongs to the slice before
            word = ~end
            word[0] = False
            crc, length = (payload & 0xFFFFFFFF).astype(np.uint32), payload >> 32
            pair = word[1:] & ~end[:-1]
            second = np.flatnonzero(pair) + 1
            both = appended(with_space(crc[second - 1]), crc[second], length[second])
            yield np.concatenate([number[word], number[second]]), np.concatenate([crc[word], both]).astype(np.int64) % buckets
            last = payload[-1:]
            at += ended

    def close(self) -> None:
        self._anew()
        release_memory()


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> dict[int, int]:
    """Features in each bucket: ``buckets`` numbers, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, total = WordScanner(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in scanner.features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        scanner.close()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    counted = texts.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket bigint, n bigint")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the ratio of smoothed shares) of each bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    ratio = lambda b: ((target.get(b, 0) + 1) * (s_all + buckets)) / ((corpus.get(b, 0) + 1) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, gain = WordScanner(), shared.value
        for batch in batches:
            n, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for number, bucket in scanner.features(batch.column("text"), len(gain)):
                n += np.bincount(number, minlength=len(n))
                np.add.at(total, number, gain[bucket])
            weight = total // np.maximum(n, 1)  # floors go down
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((n + 1) // 2), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        scanner.close()

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(weigh, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


@F.pandas_udf(LongType())
def _gumbel(head: pd.Series) -> pd.Series:
    """floor(-1000 ln(-ln u)) for u = (h + 0.5) / 2**32, by the C library's logarithm."""
    return head.map(lambda h: math.floor(-1000 * math.log(-math.log((int(h, 16) + 0.5) / 4294967296))))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Every row's n_features, weight, score and rank (null where it isn't drawn)."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    rows = weighted(docs, gain, id_col, text_col).withColumn("score", F.col("weight") + _gumbel(head))
    rows = staged(rows, "scores")
    able = rows.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    # Only scores from that of the last one drawn on are ordered.
    cells = able.groupBy("score").count()
    top = _lowest_drawn(cells, drawn)
    enough = F.col("n_words") >= least_words
    numbered = ranked(rows.where(enough & (F.col("score") >= top)), [], -F.col("score"), [F.col("doc_id").asc_nulls_last()], "before", "all")
    rank = F.col("before") + 1
    numbered = numbered.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = rows.where(~(enough & (F.col("score") >= top))).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return numbered.unionByName(rest)


def _lowest_drawn(cells: DataFrame, drawn: int) -> int:
    """The score at which ``drawn`` rows are reached from above. One row a score: scores are thousandths of logarithms, some 50 000 at most."""
    seen = 0
    for r in cells.orderBy(F.col("score").desc()).toLocalIterator():
        seen += r["count"]
        if seen >= drawn:
            return r["score"]
    return 2**62


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# CRC-32 bit by bit as a table, then byte by byte over the distinct features.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, text FROM documents),
dw AS (SELECT n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT n, f, count(*) AS c FROM (SELECT n, unnest(w) AS f FROM dw UNION ALL SELECT n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM dw) GROUP BY n, f),
bf AS (SELECT f, count(*) AS c FROM (SELECT unnest(w) AS f FROM bw UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM bw) GROUP BY f),
tab AS (SELECT list(list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
bucket AS (
  SELECT f, xor(list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: CAST(('0x' || hex(encode(f))[2 * i + 1:2 * i + 2]) AS BIGINT)),
                            lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS b
  FROM (SELECT f FROM df UNION SELECT f FROM bf), tab
),
s AS (SELECT b, sum(c) AS s FROM df JOIN bucket USING (f) GROUP BY b),
t AS (SELECT b, sum(c) AS t FROM bf JOIN bucket USING (f) GROUP BY b),
gain AS (
  SELECT g.b, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (coalesce((SELECT sum(s) FROM s), 0) + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (coalesce((SELECT sum(t) FROM t), 0) + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS b) g LEFT JOIN s ON g.b = s.b LEFT JOIN t ON g.b = t.b
),
weight AS (SELECT n, sum(c) AS n_features, CAST(floor(CAST(sum(c * gain) AS DOUBLE) / CAST(sum(c) AS DOUBLE)) AS BIGINT) AS weight FROM df JOIN bucket USING (f) JOIN gain USING (b) GROUP BY n),
scored AS (
  SELECT d.n, doc_id, len(w) AS words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM dw d LEFT JOIN weight USING (n)
),
drawn AS (SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) * 25 // 100 FROM drawn) THEN r END AS rank FROM scored LEFT JOIN drawn USING (n)
"""
