import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from strandlab.llm import hardneg, importance, urlfilter
from strandlab.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


# --- URL filter ---------------------------------------------------------------


def brute_verdict(url, rules, otherwise="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in rules:
        h, p = rule.text.split("/", 1)
        glob = lambda t, any_: "".join(any_ if c == "*" else re.escape(c) for c in t)
        fits = re.match(r"[^/]*\." + glob(h, "[^/]*") + "/" + glob(p, ".*"), "." + host + path, re.S)
        if fits and (best is None or len(rule.text) > len(best.text)):
            best = rule
    return (host, path, best.text if best else None, best.verdict if best else otherwise)


def test_url_rules_equal_regular_expressions(spark):
    rng = random.Random(4)
    part = lambda n, extra="": "".join(rng.choice("ab" + extra) for _ in range(rng.randint(1, n)))
    rules = [urlfilter.Rule(rng.choice(["allow", "block"]), f"{part(3, '*.')}.{part(2, '*')}/{part(4, '*/')}") for _ in range(60)]
    rules += [urlfilter.Rule("block", "a.b/" + "ab" * 70), urlfilter.Rule("allow", "b/"), urlfilter.Rule("block", "é.b/ü*x"), urlfilter.Rule("block", "b/é/")]
    urls = [f"{rng.choice(['http', 'HTTPS', 'x://y'])}://{part(6, '.A')}.{part(2)}/{part(9, '/')}{rng.choice(['', '?q=/', '#/a'])}" for _ in range(1500)]
    urls += [None, "", "a.b/x", "://", "http://", "http://a.b", "http://b/", "http://B", "http://b?/", "http://b#/", "http://a.b/" + "ab" * 70, "http://a.b/" + "ab" * 69 + "a"]
    urls += ["http://x.É.b/ü", "http://é.b/üaax", "http://x.é.b/ü/x\ny", "http://b/é/", "http://a.b/" + "a" * 200_000, "x" * 50_000 + "://b/", "http://ab.b/x.a.b/ab"]
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.judged(table, rules).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute_verdict(u, rules), u
    assert len({g[2] for g in got.values()}) > 20
    assert urlfilter.judged(table.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judged(table, [], "block").collect()} == {"block"}
    with pytest.raises(ValueError):
        urlfilter.ShiftAnd([urlfilter.Rule("block", "nopath")])


def test_url_rules_of_many_words():
    rules = [urlfilter.Rule("block", f"h{i}.org/p{i}") for i in range(500)]
    import pyarrow as pa

    a = urlfilter.ShiftAnd(rules)
    assert a.words > 50
    won = a.winners(pa.array([f".www.h{i}.org/p{i}/x" for i in range(500)] + [".h1.org/p2"]))
    assert list(won[:-1]) == [max((j for j in range(500) if str(i).startswith(str(j)) and j == i), default=-1) for i in range(500)] and won[-1] == -1


# --- Importance resampling ----------------------------------------------------


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def brute_resampling(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in features(text)) for texts in ([r[1] for r in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = math.floor(sum(gain(bucket(x)) for x in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r, (_, text) in zip(out, rows) if len(words(text)) >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def odd_texts(seed=2, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZ019éß漢𝒳") for _ in range(rng.randint(1, 9)))
    text = lambda k: "".join(word() + rng.choice([" ", "\n", "--", "\x00", "_", "\u00a0", "  "]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 90))) for i in range(n)]
    rows += [(None, text(40)), (None, text(40)), (3, "same words " * 30), (3, "same words " * 30), (500, None), (501, ""), (502, "!!!"), (503, "one"), (504, "q" * 5000), (505, "Z X1 " * 30)]
    return rows + [(506, text(4000)), (507, "a" * 900 + " " + "b" * 129 + " tail " * 40), (508, "-" * 3000)]


@pytest.mark.parametrize("size, known", [(importance.SLICE, importance.DICTIONARY), (700, 50)])
def test_resampling_equals_brute_force(spark, monkeypatch, size, known):
    monkeypatch.setattr(importance.WordScanner.__init__, "__defaults__", (known, importance.LONG, size))
    rows = odd_texts()
    target = [t for _, t in odd_texts(9, 20)]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, score int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(table, items).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_resampling(rows, target)


def test_scanner_slices_agree():
    import pyarrow as pa

    texts = pa.array([t for _, t in odd_texts()])
    expected = Counter((n, zlib.crc32(f.encode()) % 10_000) for n, (_, t) in enumerate(odd_texts()) for f in features(t))
    for size, known, long in ((1, 1, 4), (60, 10, 128), (4000, 300, 16), (1 << 20, 10**6, 128)):
        got = Counter()
        for number, bucket in importance.WordScanner(known, long, size).features(texts):
            got.update(zip(number.tolist(), bucket.tolist()))
        assert got == expected, (size, known, long)


def test_crc_composition():
    rng = random.Random(1)
    for n in (0, 1, 2, 7, 255, 70_000):
        a, b = rng.randbytes(20), rng.randbytes(n)
        crc = importance.appended(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert crc[0] == zlib.crc32(a + b)


def test_resampling_edge_cases(spark):
    empty, some = docs(spark, []), docs(spark, [(1, "a b " * 20), (2, None)])
    assert importance.resampled(empty, empty).count() == 0
    rows = {r.doc_id: r for r in importance.resampled(some, empty).collect()}
    assert rows[2].weight == 0 and rows[2].n_features == 0 and rows[1].rank is None  # a quarter of one is none
    assert importance.resampled(empty, some).count() == 0


# --- Hard negatives -----------------------------------------------------------


def brute_negatives(rows):
    able = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        able.append((i, [math.floor(256 * x) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for a, va, ya in able:
        if a % 50:
            continue
        score = lambda v: sum(p * q for p, q in zip(va, v))
        same = sorted((-score(v), i) for i, v, y in able if y == ya and i != a)[:5]
        other = sorted((-score(v), i) for i, v, y in able if y != ya)
        for p, i in same:
            inside = [(s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(inside[:3])]
    return sorted(out)


def vectors(seed, n, dims=6, spread=0.4):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for i in range(n):
        y = rng.randrange(4)
        rows.append((i, [c + rng.gauss(0, spread) for c in centre[y]], y if rng.random() < 0.8 else rng.randrange(10)))
    return rows


ODD = [(None, [1.0] * 6, 1), (900, None, 1), (901, [1.0] * 6, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0], 2), (903, [math.nan] * 6, 1), (904, [math.inf] * 6, 1), (950, [], 3), (951, [1.0, 2.0], 3), (1000, [0.0] * 6, 1), (1050, [-1.0, 0.5], 2)]


def mine(spark, rows, **k):
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, score int")
    relabelled = hardneg.F.when(hardneg.F.col("id") % 7 == 0, (hardneg.F.col("label") + 1) % 10).otherwise(hardneg.F.col("label"))
    return sorted(map(tuple, hardneg.hard_negatives(table, hardneg.F.col("id") % 50 == 0, relabelled, **k).collect()))


@pytest.mark.parametrize("block, group", [(hardneg.BLOCK, hardneg.ANCHORS), (37, 4)])
def test_negatives_equal_brute_force(spark, block, group):
    rows = vectors(1, 600) + ODD + [(2000 + i, [0.9, -0.3, 0.7, 0.1, 0.2, 0.4], 5) for i in range(120)]
    expected = brute_negatives(rows)
    assert len(expected) > 50
    assert mine(spark, rows, block=block, group=group) == expected


def test_negatives_edge_cases(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    large = [(i, [x * 3e15 for x in v], y) for i, v, y in vectors(3, 120, 3)]
    assert mine(spark, [(i, [x * 2e4 for x in v], y) for i, v, y in vectors(3, 120, 3)]) == brute_negatives([(i, [x * 2e4 for x in v], y) for i, v, y in vectors(3, 120, 3)])
    assert all(abs(r[4]) < 2**63 for r in mine(spark, large))  # beyond doubles and 64 bits nothing breaks
    middle = [(i, [math.floor(x * 1e6) + 1 / 256 for x in v], y) for i, v, y in vectors(4, 200, 3)]
    assert mine(spark, middle) == brute_negatives(middle)  # beyond 2**53, within 64 bits
    twice = vectors(5, 120) * 2
    assert len(mine(spark, twice)) > 0


def test_threshold_ends_before_all_rows_are_met():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 40, (8000, 3)))
    x[5] = [900, 900, 900]
    block = hardneg.Block.of(list(range(8000)), [0] * 8000, list(x))
    scored = []
    way = hardneg.Anchor.scores
    try:
        hardneg.Anchor.scores = lambda self, rows: (scored.append(len(rows)), way(self, rows))[1]
        w = hardneg.Wanted.of(0, None, None, 1)
        hardneg.search(block, block.values(), hardneg.Sought(0, -1, 0, np.array([1.0, 1.0, 1.0]), True, [w]))
    finally:
        hardneg.Anchor.scores = way
    assert list(w.ids) == [5] and sum(scored) < 500


# --- Queries ------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    mine, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = lambda d: sorted(tuple("null" if v is None or v is not v or str(v) in ("nan", "<NA>") else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert rows(mine) == rows(theirs)
