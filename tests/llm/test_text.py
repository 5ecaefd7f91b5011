import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.llm import chat, decontam, htmltext, packing, pii, quality, tokens, toxicity


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header>
<div id="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>&nbsp;text<br>line
<p>Two &lt;3 <span class="ad-inline">BUY</span> end<div class=ad>AD</div><ul><li>a<li>b</ul><form><input>Sub</form><p hidden>no</p>
<section class="comments"><p>c1</p></section><blockquote>quote</blockquote></article></main><footer>f</footer></body></html>"""


def test_blocks():
    assert htmltext.blocks(PAGE) == (3, ["Title & more", "One bold text line", "Two <3 end", "a", "b", "quote"])
    assert htmltext.blocks(None) == (0, []) and htmltext.blocks("") == (0, [])
    assert htmltext.blocks("<article><p>cut <a hre") == (3, ["cut"])
    assert htmltext.blocks("<p>a<p>b <i>c</i>d<div>x") == (0, ["a", "b cd", "x"])


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<html><head><title>x</title><body><article><p>Hi there</p></article>", (3, ["Hi there"])),
        ("<p>Hello world <span class='share'>BUY</p><p>next</p>", (0, ["Hello world", "next"])),
        ("<main><h1>T</h1><p>Long main text</p><article class='card'><p>Teaser</p></article></main>", (2, ["T", "Long main text"])),
        ("<article><p>See the <a class='related-link'>study</a> for details</p><p><a class='related-link'>Study</a></p></article>", (3, ["See the study for details"])),
        ("<article><div class='search-party-story'><p>x</p></div><h2 id='comments-on-law'>Law</h2><div class=related-stories>R</div></article>", (3, ["x", "Law"])),
        ("<article><p>5 < 6 and a<b then more text</p><p>x <textarea>rest</p><p>y</p></article>", (3, ["5 < 6 and a<b then more text", "x", "rest", "y"])),
        ("<article><p>cut <a href='x", (3, ["cut"])),
    ],
)
def test_odd_markup(page, expected):
    assert htmltext.blocks(page) == expected


def test_pages_without_landmarks_equal_brute_force(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcd") for _ in range(6))
    menus = {h: [f"<div>{word()} {h}</div>" for _ in range(6)] for h in ("h1.com", "h2.com")}
    pages = []
    for i in range(120):
        host = rng.choice(list(menus))
        shared = [line for line in menus[host] if rng.random() < 0.7]
        own = [f"<div>{word()} {i} {k}</div>" for k in range(rng.randint(0, 3))]
        at = rng.randint(0, len(shared))
        pages.append((i, f"https://{host}/{word()[:2]}/{word()[:3]}", "<body>" + "".join(shared[:at] + own + shared[at:]) + "</body>"))
    expected = {}
    for host in menus:
        of_host = sorted((u.split("/", 3)[3], i, htmltext.blocks(h)[1]) for i, u, h in pages if f"//{host}/" in u)
        for k, (path, i, lines) in enumerate(of_host):
            beside = [of_host[j] for j in (k - 1, k + 1) if 0 <= j < len(of_host)]
            partner = max(beside, key=lambda o: len(os.path.commonprefix([path, o[0]])))[2]  # the first on ties
            common = set(lines) & set(partner)  # no line occurs twice and shared ones keep their order
            copy = len(common) >= htmltext.COPY * max(len(lines), len(partner))
            expected[i] = "\n".join(x for x in lines if copy or x not in common)
    got = htmltext.extracted(spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == expected and all(r.how == "difference" for r in got)


def test_common_subsequence_is_longest():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        at = htmltext.common_subsequence(a, b)
        picked, it = [a[i] for i in at], iter(b)
        assert len(at) == table[-1][-1] and all(x in it for x in picked)


def test_pages(spark):
    plain = lambda t: f"<body><div>Menu A</div><div>{t}</div><div>Imprint</div></body>"
    rows = [(1, "https://h.com/a/1", plain("first")), (2, "https://h.com/a/2", plain("second")), (3, "https://h.com/zz", None), (4, None, PAGE), (5, "https://one.com/", plain("alone")), (6, "https://c.com/1", plain("same")), (7, "https://c.com/2", plain("same"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("level", F.lit(2))
    got = {r.page_id: r for r in htmltext.extracted(df).collect()}
    assert len(got) == 7 and got[1].text == "first" and got[2].text == "second" and got[3].text == ""
    assert got[4].text.startswith("Title & more\nOne bold text line") and got[4].how == "landmark"
    assert got[5].text == "Menu A\nalone\nImprint" and got[6].text == got[7].text == "Menu A\nsame\nImprint"
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_histogram_answers(spark):
    rng = random.Random(4)
    lengths = [rng.randint(0, 30) for _ in range(300)]
    df = docs(spark, [(i, "x" * n) for i, n in enumerate(lengths)] + [(999, None)])
    hist = tokens.length_histogram(tokens.with_token_counts(df, None))
    lengths.append(0)
    for r in tokens.context_limits(hist).collect():
        limit = r.context_limit
        assert r.tokens_truncated == sum(min(n, limit) for n in lengths) and r.tokens_lost == sum(max(0, n - limit) for n in lengths)
        assert r.docs_cut == sum(n > limit for n in lengths) and r.docs_within == sum(n <= limit for n in lengths) and r.tokens_total == sum(lengths)
    one = tokens.truncated_total(hist, 17).first()
    assert one.tokens_truncated == sum(min(n, 17) for n in lengths)
    assert tokens.length_quantile(hist, 0.5).first()[0] == sorted(lengths)[(len(lengths) - 1) // 2]
    assert tokens.context_limits(tokens.length_histogram(tokens.with_token_counts(docs(spark, []), None))).count() == 0


def test_token_counts_are_the_encoders(spark):
    texts = ["Hello world", "", "ünï<|endoftext|> 123", None, "a" * 5000]
    for n in (999, 1000, 1001, 5000):  # around the length from which white space is encoded on its own
        texts += ["a" + mark * n + tail for mark in (" ", "\n", "\t ", "\u3000") for tail in ("", "b", "!", "7", "\x1f", " \n9")]
    df = docs(spark, list(enumerate(texts)))
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens._encoder(f.read()).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(df).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}
    huge = tokens.with_token_counts(docs(spark, [(1, " " * 1_000_000), (2, "a" + "\n" * 1_000_000 + "b")])).collect()
    assert all(r.n_tokens > 0 for r in huge)


def brute_padding(lengths, counts, k):
    n, best = len(lengths), None
    for cuts in itertools.combinations(range(n - 1), min(k, n) - 1):
        bounds = [*cuts, n - 1]
        cost, lo = 0, 0
        for b in bounds:
            cost += sum((lengths[b] - lengths[i]) * counts[i] for i in range(lo, b + 1))
            lo = b + 1
        best = cost if best is None else min(best, cost)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(5)
    for _ in range(60):
        lengths = sorted(rng.sample(range(100), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        for k in (1, 2, 3, 5):
            bounds, cost = packing.best_boundaries(lengths, counts, k)
            assert cost == brute_padding(lengths, counts, k) and bounds[-1] == lengths[-1] and bounds == sorted(bounds)
    assert packing.best_boundaries([], [], 3) == ([], 0)


def test_packed_places(spark):
    rng = random.Random(6)
    df = docs(spark, [(i, "x" * rng.choice([0, 3, 3, 3, 50, rng.randint(1, 40)])) for i in range(400)] + [(None, None), (1, "x" * 500)])
    rows = packing.packed(df, None, buckets=4, token_budget=100).collect()
    assert len(rows) == 402 and len({(r.bucket, r.batch, r.slot) for r in rows}) == 402
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.bucket, r.batch)), key=lambda r: (r.bucket, r.batch)):
        group = list(group)
        assert len(group) == group[0].batch_size and sorted(r.slot for r in group) == list(range(len(group)))
        assert len(group) == 1 or len(group) * max(1, group[0].bucket_length) <= 100
        assert all(0 <= r.padding == r.bucket_length - r.n_tokens for r in group)
    assert packing.packed(docs(spark, []), None).count() == 0


ITEM = "What is the tallest mountain of the small island kingdom in the northern sea. It is called mount example of the seven winds"


def test_leaks(spark):
    rng = random.Random(7)
    filler = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(n))
    items = spark.createDataFrame([(1, ITEM), (2, "Completely different question about blue cheese. Nobody knows"), (3, None), (4, "")], "item_id bigint, text string")
    rows = [(1, filler(500) + " " + ITEM.upper().replace(".", " !") + " " + filler(300)), (2, filler(200)), (3, None), (4, "What is the tallest mountain"), (5, ITEM), (5, ITEM), (6, ITEM.replace("northern", "southern"))]
    got = sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, rows), items).collect())
    assert got == [(1, 1), (5, 1), (5, 1), (6, 1)]
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(docs(spark, rows), items, index_words=10).collect()) == got
    assert decontam.contaminated(docs(spark, rows), items.limit(0)).count() == 0
    split = items.withColumn("answer", F.lit("mount example"))
    assert decontam.contaminated(docs(spark, [(9, ITEM + " mount example")]), split.limit(1), answer_col="answer").count() == 1


def test_dealing_items_changes_nothing(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(90)]
    text = lambda k: " ".join(rng.choices(vocab, k=k))
    items = [(i, text(rng.randint(5, 60)) + ". " + text(6)) for i in range(60)]
    items += [(60, items[3][1])] + [(61, items[4][1])] * 30 + [(61, None)]  # repeated rows are items each
    rows = [(i, text(80) + " " + items[i][1] + " " + text(80)) for i in range(0, 60, 2)] + [(100 + i, text(150)) for i in range(20)]
    table = spark.createDataFrame(items, "item_id bigint, text string").repartition(3)
    found = []
    for size in (10**6, 400, 30):
        got = decontam.contaminated(docs(spark, rows), table, index_words=size).collect()
        found.append(sorted((r.doc_id, r.item_id, *(round(x, 9) for x in r[2:])) for r in got))
    assert found[0] == found[1] == found[2] and len(found[0]) >= 30
    assert sum(r[1] == 61 for r in found[0]) == 30 * sum(r[1] == 61 for r in set(found[0]))
    best = plain_bm25([(i, t, None) for i, t in items if t], [decontam.words(rows[0][1])[s : s + decontam.WINDOW] for s in range(0, len(decontam.words(rows[0][1])) - decontam.STRIDE, decontam.STRIDE)], 0.5)
    assert {r[1]: r[2] for r in found[0] if r[0] == 0} == pytest.approx({i: best[i] for i in {r[1] for r in found[0] if r[0] == 0}})


def plain_bm25(items, passages, threshold):
    """Best score of each item over all passages, without an index."""
    from collections import Counter
    from math import log

    pieces = []
    for i, text, _ in items:
        w = decontam.words(text)
        n = -(-len(w) // decontam.PIECE)
        size = -(-len(w) // n)
        pieces += [(i, Counter(w[k : k + size])) for k in range(0, len(w), size)]
    df, mean = Counter(t for _, p in pieces for t in p), sum(sum(p.values()) for _, p in pieces) / len(pieces)

    def weights(p):
        norm = decontam.K1 * (1 - decontam.B + decontam.B * sum(p.values()) / mean)
        out = {t: log(1 + (len(pieces) - df[t] + 0.5) / (df[t] + 0.5)) * c * (decontam.K1 + 1) / (c + norm) for t, c in p.items()}
        return {t: v / sum(out.values()) for t, v in out.items()}

    best = {}
    for i, p in pieces:
        w = weights(p)
        for words in passages:
            score = sum(w.get(t, 0) for t in set(words))
            if score >= threshold:
                best[i] = max(best.get(i, 0), score)
    return best


@pytest.mark.parametrize("slice_words", [32, 96, 2048])
def test_retrieval_equals_plain_bm25(monkeypatch, slice_words):
    monkeypatch.setattr(decontam, "SLICE", slice_words)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(5, 70))), None) for i in range(40)]
    ix = decontam.ItemIndex.build(items)
    for _ in range(30):
        words = rng.choices(vocab + ["zz"], k=rng.randint(1, 300))
        starts = range(0, max(1, len(words) - decontam.STRIDE), decontam.STRIDE)
        expected = plain_bm25(items, [words[s : s + decontam.WINDOW] for s in starts], 0.6)
        assert {ix.item_ids[i]: v for i, v in ix.retrieve(ix.numbers(words), 0.6).items()} == pytest.approx(expected)


def test_very_long_texts_and_items():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    item = " ".join(rng.choices(vocab, k=20_000))
    ix = decontam.ItemIndex.build([(1, item, None), (2, "other words entirely, none of these here", None)])
    text = rng.choices(vocab, k=300_000) + decontam.words(item) + rng.choices(vocab, k=1000)
    assert ix.retrieve(ix.numbers(text), 0.5).keys() == {0}


def test_neighbours_of_a_large_host(spark):
    html = lambda i: f"<body><div>Menu of section {i // 2}</div><div>text {i}</div><div>more {i}</div></body>"
    rows = [(i, f"https://h.com/s{i // 2:05d}/{i % 2}", html(i)) for i in range(2 * htmltext.SHARD + 302)]
    got = htmltext.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}\nmore {i}" for i, _, _ in rows} and len(got) == len(rows)


CASES = ["mail jo.81@mail7.example.com, or x@y.org.", "call +1 (984) 555-5227 now", "card 4111 1111 1111 1111.", "card 4111 1111 1111 1112.", "ip 224.228.19.86. next 999.1.1.1", "born 1985-03-12 and 31.12.1999; 2001-02-30", "ssn 123-45-6789 000-12-3456", None, "", "no hits", "1.2.3.4.5", "jo.81@mail7.example.com again"]


def test_pseudonyms_round_trip(spark):
    df = docs(spark, list(enumerate(CASES))).withColumn("found", F.lit(1))
    out = pii.pseudonymised(df, "k")
    rows = {r.doc_id: r for r in out.collect()}
    assert {r.doc_id: r.text for r in pii.pseudonymised(out.select("doc_id", "text"), "k", back=True).collect()} == dict(enumerate(CASES))
    assert rows[3].text == CASES[3] and rows[9].text == "no hits" and rows[10].text == CASES[10] and rows[7].text is None
    assert "999.1.1.1" in rows[4].text and "224.228.19.86" not in rows[4].text and "2001-02-30" in rows[5].text
    assert rows[0].found[0].pseudonym == rows[11].found[0].pseudonym != "jo.81@mail7.example.com"
    digits = [int(c) for c in rows[2].text if c.isdigit()]
    assert len(digits) == 16 and sum(d if i % 2 == 0 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(reversed(digits))) % 10 == 0
    assert pii.pseudonymised(df, "other").where("doc_id = 1").first().text != rows[1].text


def test_cards_beside_other_numbers(spark):
    long, short = "4465758382889437", "4111 1111 1111 1111"
    cases = [f"{long} {long}", f"{long} 12/27", f"12 {long}", f"{long} 123", f"{short} 12/27", f"{short} 123", f"12 {short}", f"{short} {short}", f"555-123-4567 {short}", f"123-45-6789 {long}", f"{long} 2024-01-31", f"3782 822463 10005 {long}", f"{long} 555-123-4567", f"{long}@mail.example.com"]
    out = pii.pseudonymised(docs(spark, list(enumerate(cases))), "k")
    rows = {r.doc_id: r for r in out.collect()}
    assert not [r.text for r in rows.values() if long in r.text or short in r.text]
    assert [[f.kind for f in rows[i].found] for i in range(len(cases))] == [["card"] * 2, ["card"], ["card"], ["card"], ["card"], ["card"], ["card"], ["card"] * 2, ["phone", "card"], ["ssn", "card"], ["card", "date"], ["card"] * 2, ["card", "phone"], ["email"]]
    assert len({f.pseudonym for i in (0, 1, 2, 3, 9) for f in rows[i].found if f.kind == "card"}) == 1  # linked wherever it stands
    assert all(rows[i].text == rows[i].text.translate({0xFDD0: None, 0xFDD1: None}) for i in rows)
    assert {r.doc_id: r.text for r in pii.pseudonymised(out.select("doc_id", "text"), "k", back=True).collect()} == dict(enumerate(cases))


def iban_valid(text):
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def test_ibans(spark):
    cases = ["pay DE89 3704 0044 0532 0130 00 now", "GB82WEST12345698765432.", "FR14 2004 1010 0505 0001 3M02 606", "DE89 3704 0044 0532 0130 01", "PL61 1090 1014 0000 0712 1981 2874 and +1 (984) 555-5227", "NL91ABNA0417164300"]
    out = pii.pseudonymised(docs(spark, list(enumerate(cases))), "k")
    rows = {r.doc_id: r for r in out.collect()}
    for i in (0, 1, 2, 4, 5):
        found = [f for f in rows[i].found if f.kind == "iban"]
        assert len(found) == 1 and iban_valid(found[0].original) and iban_valid(found[0].pseudonym) and len(found[0].pseudonym) == len(found[0].original)
        assert rows[i].text == cases[i].replace(found[0].original, found[0].pseudonym) or i == 4
    assert rows[3].text == cases[3] and [f.kind for f in rows[4].found] == ["iban", "phone"]
    assert {r.doc_id: r.text for r in pii.pseudonymised(out.select("doc_id", "text"), "k", back=True).collect()} == dict(enumerate(cases))


def test_dates_are_permuted_within_their_notation(spark):
    import datetime

    shape = lambda s: re.sub(r"\d", "9", s)
    days = [datetime.date(y, 1, 1) + datetime.timedelta(k) for y in (1900, 1996) for k in range(0, 366, 5)] + [datetime.date(y, m, d) for y in (1996, 1999, 2096) for m in (2, 9, 12) for d in (1, 9, 28)] + [datetime.date(y, 2, 29) for y in (1904, 1996, 2096)]
    notations = [lambda d: d.isoformat(), lambda d: f"{d.month}/{d.day}/{d.year}", lambda d: f"{d.month:02}/{d.day:02}/{d.year}", lambda d: f"{d.month}/{d.day:02}/{d.year}", lambda d: f"{d.month:02}/{d.day}/{d.year}", lambda d: f"{d.day}/{d.month}/{d.year}", lambda d: f"{d.day:02}/{d.month:02}/{d.year}", lambda d: f"{d.day}.{d.month}.{d.year}", lambda d: f"{d.day:02}.{d.month:02}.{d.year}"]
    cases = sorted({f(d) for d in days for f in notations} | {f'{m}/31/1999' for m in (1, 3, 10)})
    out = pii.pseudonymised(docs(spark, list(enumerate(cases))), "k")
    rows = {r.doc_id: r for r in out.collect()}
    new = [rows[i].text for i in range(len(cases))]
    assert len(set(new)) == len(cases) and all(shape(a) == shape(b) for a, b in zip(cases, new))
    assert sum(a == b for a, b in zip(cases, new)) < 30  # few stay by chance

    def real(text):
        a, b, c = (int(x) for x in re.split("[-/.]", text))
        for y, m, d in ((a, b, c), (c, a, b), (c, b, a)):
            try:
                return datetime.date(y, m, d)
            except ValueError:
                pass

    assert all(real(t) for t in new)
    assert {r.doc_id: r.text for r in pii.pseudonymised(out.select("doc_id", "text"), "k", back=True).collect()} == dict(enumerate(cases))
    left = ["31/31/1999", "2001-02-30", "1/1/1850", "29/2/1999"]
    assert sorted(r.text for r in pii.pseudonymised(docs(spark, list(enumerate(left))), "k").collect()) == sorted(left)


def brute_digits(digits, key, tweak):
    """The Feistel network in plain Python."""
    import hashlib

    u = len(digits) // 2
    l, r, a, b = int(digits[:u]), int(digits[u:]), 10**u, 10 ** (len(digits) - u)
    for i in range(pii.ROUNDS):
        other = r if i % 2 == 0 else l
        h = int(hashlib.sha256(f"{key}|{tweak}|{i}|{other}/{a}/{b}".encode()).hexdigest()[:13], 16)
        l, r = ((l + h) % a, r) if i % 2 == 0 else (l, (r + h) % b)
    return f"{l:0{u}}{r:0{len(digits) - u}}"


def test_permuted_digits_equal_brute_force(spark):
    rng = random.Random(12)
    cases = ["".join(rng.choices("0123456789", k=n)) for n in (2, 3, 9, 10, 15, 18, 30) for _ in range(5)]
    got = docs(spark, list(enumerate(cases))).select("text", pii.permute_digits(F.col("text"), "k", "t").alias("p")).collect()
    assert {r.text: r.p for r in got} == {c: brute_digits(c, "k", "t") for c in cases}
    phone = pii.pseudonymised(docs(spark, [(1, "call +1 (984) 555-5227 now")]), "k").first()
    d = brute_digits("9845555227", "k", "phone")
    assert phone.text == f"call +1 ({d[:3]}) {d[3:6]}-{d[6:]} now"


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    out = df.select(pii.permute_digits(F.col("d"), "k", "t").alias("e")).distinct()
    assert out.count() == 1000 and out.where("length(e) <> 3").count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "sys"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "cy", "x"), (2, 0, None, "q"), (None, 0, "ann", "z"), (3, 0, "system", "only")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.speaker): r for r in chat.rotated(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "cy"), (2, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r.text == "<|system|>\nsys<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n<|user name=cy|>\nx<|end|>\n"
    assert [r.text[m.start : m.stop] for m in r.mask] == ["hi<|end|>"] and (r.n_turns, r.own_turns) == (4, 1)
    assert chat.rotated(df.limit(0)).count() == 0


def brute_rotation(rows, speaker):
    """The whole rendering of one conversation and its mask spans."""
    text, spans = "", []
    for _, role, said in sorted((t if t is not None else -(10**9), r or "unknown", re.sub(r"<(\\*)\|", r"<\\\1|", s or "")) for t, r, s in rows):
        text += "<|assistant|>\n" if role == speaker else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
        if role == speaker:
            spans.append((len(text), len(text) + len(said) + len("<|end|>")))
        text += said + "<|end|>\n"
    return text, spans


@pytest.mark.parametrize("part_turns", [1, 7, 512])
def test_parts_are_the_whole_rendering(spark, part_turns):
    rng = random.Random(11)
    rows = [(c, rng.choice([None, -5, 3, 10**6, *range(20)]), rng.choice(["ann", "bob", "system", None, "é"]), rng.choice(["x" * rng.randint(0, 9), None, "<|end|> <\\|assistant|>", "é"])) for c in (1, 2, None) for _ in range(60)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("k", F.lit("x")).withColumn("part", F.lit(3)).repartition(5)
    got = {}
    for r in sorted(chat.rotated(df, part_turns=part_turns).collect(), key=lambda r: r.part):
        text, spans = got.get((r.conv_id, r.speaker), ("", []))
        assert r.start == len(text) and r.n_turns <= part_turns
        got[r.conv_id, r.speaker] = text + r.text, spans + [(m.start, m.stop) for m in r.mask]
    assert got == {(c, s): brute_rotation([r[1:] for r in rows if r[0] == c], s) for c in (1, 2, None) for s in ("ann", "bob", "unknown", "é")}


def labelled(spark, make, n=300):
    rng = random.Random(9)
    rows = [(i, make(rng, i % 2), i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, y int")
    return df.select("doc_id", "text"), df.select("doc_id", F.col("y").alias("quality"), F.col("y").alias("toxic"))


def test_compression_quality(spark):
    words = ["the", "river", "stone", "walked", "under", "green", "and", "morning", "light", "slowly"]
    make = lambda rng, good: " ".join(rng.choices(words, k=80)) + "." if good else "!!! ".join(rng.choices(["BUY", "WIN", "###", "$$$"], k=80))
    df, labels = labelled(spark, make)
    model = quality.fit(df, labels, per_class=100)
    rows = quality.score_quality(df.unionByName(docs(spark, [(None, None), (-1, "")])), model).collect()
    assert np.mean([(r.score >= 0.7) == (r.doc_id % 2 == 1) for r in rows if r.doc_id is not None and r.doc_id >= 0]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(df, quality.fit(df, labels.limit(0))).first().score == 0.5


def test_nearest_toxic(spark):
    make = lambda rng, bad: " ".join(rng.choices([f"w{i}" for i in range(200)], k=40)) + (" you stupid clown " if bad else "")
    df, labels = labelled(spark, make)
    index = toxicity.fit(df, labels, per_class=100)
    rows = toxicity.score_toxicity(df.unionByName(docs(spark, [(-1, None), (-2, "STUPID!")])), index).collect()
    assert np.mean([(r.toxicity.score >= 0.5) == (r.doc_id % 2 == 1) for r in rows if r.doc_id >= 0]) > 0.97
    assert {r.doc_id: r.toxicity.score >= 0.5 for r in rows if r.doc_id < 0} == {-1: False, -2: True}
    assert toxicity.score_toxicity(df, None).first().toxicity.score == 0.5


def test_nearest_and_votes_equal_brute_force():
    rng = random.Random(10)
    vocab = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(vocab[: 20 if i % 2 else 30], k=12)), i % 2) for i in range(200)]
    ix = toxicity.fit_examples(rows, 0.1, least_chi2=0.5)
    dense = np.zeros((len(ix.ids), len(ix.terms)))
    for row, (at, w) in zip(dense, ix.vectors):
        row[at] = w
    checked = 0
    for _ in range(40):
        text = " ".join(rng.choices(vocab, k=8))
        tf = {ix.terms[t]: n for t, n in toxicity.term_counts(text).items() if t in ix.terms}
        if not tf:
            continue
        v = np.zeros(len(ix.terms))
        for t, n in tf.items():
            v[t] = (1 + np.log(n)) * ix.idf[t]
        full = dense @ (v / np.sqrt(v @ v))
        order = sorted((i for i in range(len(full)) if full[i] > 0), key=lambda i: (-round(full[i], 6), ix.ids[i]))[:15]
        z, pos, cosines = ix.log_odds(text, {})
        assert pos.tolist() == order and cosines == pytest.approx(full[order])
        share = [sum(u for u, y in zip(ix.votes, ix.labels) if y == c) / ix.votes.sum() for c in (0, 1)]
        votes = [0.5 * share[c] + sum(ix.votes[i] * full[i] ** 2 for i in order if ix.labels[i] == c) for c in (0, 1)]
        assert z == pytest.approx(np.log(votes[1] / votes[0])) and share[1] == pytest.approx(0.1)
        checked += 1
    assert checked > 30


def test_compression_score_equals_brute_force():
    import zstandard

    rng = random.Random(13)
    texts = [" ".join(rng.choices(["the", "river", "stone"] if i % 2 else ["BUY!!", "###", "WIN"], k=rng.randint(5, 900))) for i in range(120)]
    model = quality.fit_compression(texts, [i % 2 for i in range(120)])

    def size(text, words):
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False)
        raw = text.encode()
        return 1 + sum(len(packer.compress(raw[k : k + quality.PIECE])) for k in range(0, len(raw), quality.PIECE))

    for text in [*texts[:20], "", "é" * 5000]:
        g, b, n = size(text, model.good), size(text, model.bad), len(text.encode())
        x = np.array([(g - b) / (g + b), min(g, b) / (n + 8), (min(g, b) / (n + 8)) ** 2, np.log1p(n), (g - b) / np.sqrt(g + b)])
        z = ((x - model.mean) / model.scale) @ model.weights[:-1] + model.weights[-1]
        assert model.scorer()([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)
    scores = model.scorer()(texts)
    assert min(scores[1::2]) > 0.5 > max(scores[::2])


def test_held_out_rows(spark):
    got = {r.doc_id: r.h for r in docs(spark, [(i, "") for i in range(50)]).select("doc_id", quality.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)}
    assert docs(spark, [(None, "")]).select(quality.held_out().alias("h")).first().h is False
