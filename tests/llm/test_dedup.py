import collections
import random

import numpy as np
import pytest

from strandlab.llm import bagminhash as B
from strandlab.llm import exact_dedup, neardup


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


EDGE = [(3, "a  b"), (1, "a\tb"), (2, "a b"), (2, "a b"), (None, "a b"), (5, None), (4, ""), (6, " "), (7, "x" * 100_000), (8, "ünï   x")]


def test_exact_groups_edge_cases(spark):
    rows = exact_dedup.exact_groups(docs(spark, EDGE)).collect()
    assert len(rows) == len(EDGE)
    ab = [r for r in rows if r.group_size == 5]
    assert {r.keep_id for r in ab} == {1} and sum(r.kept for r in ab) == 1
    empty = [r for r in rows if r.doc_id in (4, 5)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(4, 2)}
    assert [r for r in rows if r.doc_id == 6][0].group_size == 1  # one space isn't empty
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_exact_repeated_rows_keep_one(spark):
    rows = exact_dedup.exact_groups(docs(spark, [(1, "q"), (1, "q"), (1, "other")])).collect()
    assert sorted((r.kept, r.group_size) for r in rows) == [(False, 2), (True, 1), (True, 2)]


def test_merge_rounds_agree(spark):
    rng = random.Random(1)
    df = docs(spark, [(i, rng.choice("abcdefgh") * rng.randint(1, 3)) for i in range(500)]).repartition(40)
    one, many = (sorted(map(tuple, exact_dedup.exact_groups(df, fan_in=f).drop("rid").collect())) for f in (2, 64))
    assert one == many


def test_drop_exact_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a  b", "y"), (3, "c", None)], "doc_id bigint, text string, keep_id string")
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(df).collect())) == [(1, "a b", "x"), (3, "c", None)]
    twice = df.unionByName(df)
    assert sorted(map(tuple, exact_dedup.drop_exact_copies(twice).collect()))[0] == (1, "a b", "x")
    assert exact_dedup.drop_exact_copies(twice).count() == 2


def test_signatures_are_unbiased():
    a, b = {1: 1, 2: 3, 3: 7, 4: 20}, {1: 1, 2: 5, 3: 4, 5: 6}
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(9)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(9))
    owner, element, weight = [], [], []
    for t in range(150):
        for side, s in enumerate((a, b)):
            for k, w in s.items():
                owner.append(2 * t + side)
                element.append(t * 100 + k)
                weight.append(w)
    s = B.signatures(np.array(owner), B.mix(np.array(element, np.uint64)), np.array(weight), 300, 256)
    assert abs((s[::2] == s[1::2]).mean() - true) < 0.012
    assert np.isinf(B.signatures(np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int), 1, 8)).all()


def brute_classes(rows):
    grams = {}
    for i, text in rows:
        w = neardup.words_of(text)
        grams[i] = collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()
    parent = {i: i for i in grams}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(grams)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common, union = sum((grams[i] & grams[j]).values()), sum((grams[i] | grams[j]).values())
            if union == 0 or common >= 0.8 * union:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # one family with zero to eight edits
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    passage = " ".join(word() for _ in range(60))
    for i in range(60, 100):  # unrelated texts around one passage
        rows.append((i, " ".join(word() for _ in range(40)) + " " + passage))
    rows += [(100, "spam " * 500), (101, "spam " * 480), (102, "spam " * 100), (103, None), (104, ""), (105, "one two"), (106, "One, two!"), (107, "###"), (108, "$$$")]
    return rows


@pytest.mark.parametrize("meets", [0, 4, 1000])
def test_near_classes_equal_brute_force(spark, monkeypatch, meets):
    monkeypatch.setattr(neardup, "MEETS", meets)
    rows = corpus()
    got = neardup.near_classes(docs(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def variants(n, words=44, seed=5):
    """One-word variants of one text that isn't among them: many share buckets, few are linked."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    return [(i, " ".join(base[:at] + [f"x{i}"] + base[at + 1 :])) for i in range(n) for at in [rng.randrange(words)]]


def test_pairs_of_a_crowd_do_not_grow_with_its_square(spark, monkeypatch):
    counts, staged = {}, neardup.staged

    def counted(df, tag):
        out = staged(df, tag)
        counts.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    for n in (150, 300):
        rows = variants(n)
        got = neardup.near_classes(docs(spark, rows)).collect()
        assert {r.doc_id: r.class_id for r in got} == brute_classes(rows)
    for tag in ("pairs", "rest", "met", "rarest"):
        assert counts[tag][1] <= max(60, 2.5 * counts[tag][0]), (tag, counts[tag])


def templates(n, seed=8):
    """Texts of 120 words from one template, 13 slots with 4 fillings each; every 25th fills one slot of the text before anew."""
    rng = random.Random(seed)
    base, at = [f"w{i}" for i in range(120)], sorted(rng.sample(range(120), 13))
    rows, last = [], None
    for i in range(n):
        fill = [rng.randrange(4) for _ in at] if last is None or i % 25 else [(last[0] + 1) % 4, *last[1:]]
        words = list(base)
        for slot, f in zip(at, fill):
            words[slot] = f"s{slot}f{f}"
        rows.append((i, " ".join(words)))
        last = fill
    return rows


def brute_sets(rows):
    """Classes of texts without repeated five-grams."""
    grams = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) for i, w in ((i, t.split()) for i, t in rows)]
    label = {i: i for i, _ in grams}
    for n, (i, a) in enumerate(grams):
        for j, b in grams[:n]:
            common = len(a & b)
            if common >= 0.8 * (len(a) + len(b) - common) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def test_pairs_of_a_template_do_not_grow_with_its_square(spark, monkeypatch):
    counts, staged = {}, neardup.staged

    def counted(df, tag):
        out = staged(df, tag)
        counts.setdefault(n, {}).setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(neardup, "staged", counted)
    for n in (200, 400, 800):
        rows = templates(n)
        got = neardup.near_classes(docs(spark, rows)).collect()
        assert {r.doc_id: r.class_id for r in got} == brute_sets(rows)
        assert sum(r.class_id != r.doc_id for r in got) >= n // 25 - 1
    pairs = {n: {t: sum(c.get(t, [0])) for t in ("pairs", "met", "rest", "deep_met", "deep_pairs", "crowd_pairs", "rarest")} for n, c in counts.items()}
    # Rows for each text: one anchor a key bounds "pairs", DENSE "met", DENSE_MEETS "deep_met"; of what passes the bits one is verified.
    bound = {"pairs": neardup.BANDS, "met": neardup.DENSE, "deep_met": neardup.DENSE_MEETS, "deep_pairs": 1, "crowd_pairs": 1, "rest": 1}
    for n in (400, 800):
        for tag, c in pairs[n].items():
            assert c <= max(60, 2.5 * pairs[n // 2][tag], bound.get(tag, 0) * n), (tag, pairs)


def test_near_edge_cases(spark):
    assert neardup.near_classes(docs(spark, [])).count() == 0
    rows = neardup.near_classes(docs(spark, [(None, "q w e r t y"), (4, "q w e r t y"), (4, "q w e r t y")])).collect()
    assert {r.class_id for r in rows} == {4} and sum(r.kept for r in rows) == 1
    kept = neardup.drop_near_copies(spark.createDataFrame([(1, "q w e r t y", 0), (2, "q w e r t y", 1)], "doc_id bigint, text string, node int"))
    assert [tuple(r) for r in kept.collect()] == [(1, "q w e r t y", 0)]
