"""URL filters: allow and block rules with wildcards, all simulated at once by bit-parallel Shift-And masks.

A rule is ``host/path`` text. It fits its host and all subdomains, where the URL's
path starts with the rule's; ``*`` stands for any run of characters, in the host
for one without a slash. Of the rules that fit the longest text wins, of equally
long ones the first given; where none fits, ``otherwise`` decides.

A URL's canonical form is ``.`` + host + path: the host is what stands after the
first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case, the
path goes on up to ``?``, ``#`` or the end. Each rule takes one bit for its start
and one for each character but ``*``; bits of all rules are packed into 64-bit
words, one after another and over the words' borders. A step shifts all words of
all URLs of a batch by one bit (carries pass between words) and masks them with
the words of the character read. A state before a ``*`` also keeps itself; so does
a rule's start while the host lasts (subdomains) and its last bit (any rest). URLs
leave the batch once no rule is half read, so a long query, path or text that is
no URL costs what is read of it.

Edge cases: a null URL or one without ``://`` has empty host and path and fits no
rule (each has a slash); empty tables give empty results; repeated rows are judged
alike; null ids are kept; other columns of the table, whatever their names, are
not read. Characters beyond ASCII are compared as their UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.llm._common import table

_END = 256  # read after a URL's last byte: every state stays
_CHECK = 16  # steps between two looks at who is still reading
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    text: str  # host/path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL_PARTS, 1), _UPPER, _LOWER), F.regexp_extract(url, URL_PARTS, 2)


class ShiftAnd:
    """All rules as one automaton over bytes."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        starts, literals, loops, ends = [], [], [], []
        bit = 0
        for rule in rules:
            host, slash, path = rule.text.partition("/")
            if not slash or not host:
                raise ValueError(f"a rule is host/path: {rule.text!r}")
            starts.append(bit)
            loops.append((bit, True))
            for part, in_host in ((b"." + host.encode(), True), (b"/" + path.encode(), False)):
                for c in part:
                    if c == ord("*"):
                        loops.append((bit, in_host))
                    else:
                        bit += 1
                        literals.append((bit, c))
            loops.append((bit, False))
            ends.append(bit)
            bit += 1
        self.words = -(-bit // 64) or 1
        self.read = np.zeros((_END + 1, self.words), np.uint64)  # bits that a byte moves into
        self.stay = np.zeros((_END + 1, self.words), np.uint64)  # bits that a byte keeps
        for b, c in literals:
            self.read[c, b // 64] |= self._mask(b)
        for b, in_host in loops:
            kept = np.ones(_END, bool)
            kept[ord("/")] = not in_host
            self.stay[:_END][kept, b // 64] |= self._mask(b)
        self.stay[_END] = ~np.uint64(0)
        self.start = np.zeros(self.words, np.uint64)
        self.half = np.zeros(self.words, np.uint64)  # bits of rules that aren't read to their end
        for b in range(bit):
            self.half[b // 64] |= self._mask(b)
        for b in starts:
            self.start[b // 64] |= self._mask(b)
        for b in ends:
            self.half[b // 64] &= ~self._mask(b)
        # The longest rule first, then the first given.
        self.order = sorted(range(len(rules)), key=lambda r: (-len(rules[r].text), r))
        self.ends = ends

    @staticmethod
    def _mask(bit: int) -> np.uint64:
        return np.uint64(1) << np.uint64(bit % 64)

    def states(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The words after each text ``data[begin:end]``."""
        final = np.zeros((len(begin), self.words), np.uint64)
        who, at = np.arange(len(begin)), begin.astype(np.int64)
        state = np.tile(self.start, (len(begin), 1))
        step = 0
        while len(who):
            inside = at < end[who]
            c = np.where(inside, data[np.where(inside, at, 0)], _END) if len(data) else np.full(len(who), _END)
            moved = state << np.uint64(1)
            moved[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (moved & self.read[c]) | (state & self.stay[c])
            at += 1
            step += 1
            if step % _CHECK == 0:
                live = (at < end[who]) & (state & self.half).any(axis=1)
                final[who[~live]] = state[~live]
                who, at, state = who[live], at[live], state[live]
        return final

    def winners(self, texts: pa.Array) -> np.ndarray:
        """Number of the winning rule of each canonical text, -1 where none fits."""
        raw = texts.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        reached = self.states(data, offsets[:-1], offsets[1:]) & ~self.half
        won = np.full(len(raw), -1, np.int32)
        open_ = np.flatnonzero(reached.any(axis=1))
        for r in self.order:
            if not len(open_):
                break
            fits = (reached[open_, self.ends[r] // 64] & self._mask(self.ends[r])) != 0
            won[open_[fits]] = r
            open_ = open_[~fits]
        return won


def judged(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow", url_col: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` of every row with host, path, rule (null where none fits) and verdict."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__kept"), host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("__kept.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    automaton = ShiftAnd(rules)

    @F.arrow_udf("int")
    def winner(texts: pa.Array) -> pa.Array:
        return pa.array(automaton.winners(texts))

    won = rows.withColumn("won", winner(F.concat(F.lit("."), "host", "path")) + 1)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("won"))
    return won.select("__kept.*", "host", "path", pick([None, *(r.text for r in rules)]).alias("rule"), pick([otherwise, *(r.verdict for r in rules)]).alias("verdict"))


RULES = [Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/")]


def op13_wildcard_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), fit AS (
  SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM parts p LEFT JOIN fit f ON p.n = f.n
"""
