"""Operators of the training-data part against brute force on small fixtures."""

import random
import re
import unicodedata
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import components, encode, fold, leak, near_pairs, oracles, overlap, queries

from ..conftest import SMALL

QUERIES, SQL = queries.queries(), oracles.oracles()
WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall(t.lower()) if t else []


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SMALL), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_with_unique_rows(spark, name):
    rows = [str(r) for r in QUERIES[name](spark, SMALL).collect()]
    assert rows and len(rows) == len(set(rows))


# --- 1 ---------------------------------------------------------------------


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "a"] * 5
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                t.insert(rng.randrange(len(t) + 1), rng.choice(vocabulary))
                t.pop(rng.randrange(len(t)))
            if rng.random() < 0.3:
                rng.shuffle(t)
        else:
            t = [rng.choice(vocabulary) for _ in range(rng.randint(3, 14))]
        texts.append(" ".join(t))
    return texts + ["", None, "!!", "same text here now", "same text here now", "Same, text: here now"]


def likeness(a, b):
    a, b = set(words(a)), set(words(b))
    return len(a & b) / len(a | b)


def brute(rows, threshold=0.7):
    known = [(i, t) for i, t in rows if words(t)]
    return {tuple(sorted((i, j))) for (i, a), (j, b) in combinations(known, 2) if likeness(a, b) >= threshold - 1e-9}


@pytest.mark.parametrize("rare,block", [(1, 4), (2, 1000), (256, 3)])
@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9])
def test_near_pairs_equal_brute_force(spark, rare, block, threshold):
    rows = [(f"q{i}", t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame([*rows, *rows[:5], (None, "w1 w2 w3")], "id string, question string").withColumn("cls", F.lit(1))
    got = [(r["id_a"], r["id_b"]) for r in near_pairs.near_pairs(df, "id", "question", threshold, rare, block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, threshold)


def test_columns_stay_in_proportion_to_the_words():
    rng = np.random.default_rng(0)
    for threshold in (0.5, 0.7, 0.9):
        for n in (1, 2, 3, 10, 30, 47, 60, 300, 1000, 5000):
            h = rng.integers(0, 1 << 63, n).astype(np.uint64)
            row, key, place = near_pairs.grams(h, np.array([n]), np.full(near_pairs.BUCKETS, 10**6), 10**6, threshold, 256)
            # A row emits for its own bound and, near the edge of one, for the next shorter columns.
            assert 0 < len(key) <= 2 * near_pairs.COLUMNS * n and len(set(key.tolist())) == len(key)


def test_near_pairs_of_frequent_words(spark):
    import time

    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = [rng.sample(vocabulary, 300) for _ in range(150)]
    texts += [t[:rng.randint(240, 300)] + rng.sample(vocabulary, 10) for t in texts[:60]]
    rows = [(f"q{k:03}", " ".join(t)) for k, t in enumerate(texts)]
    began = time.time()
    got = {(r["id_a"], r["id_b"]) for r in near_pairs.near_pairs(spark.createDataFrame(rows, "id string, question string"), "id", "question", rare=1).collect()}
    assert got == brute(rows) and len(got) >= 60 and time.time() - began < 60


def test_near_pairs_of_short_texts(spark):
    rows = [("a", "x"), ("b", "x"), ("c", "x y"), ("d", "x y z"), ("e", "x y z v"), ("f", "y x"), ("g", "x " * 5000)]
    df = spark.createDataFrame(rows, "id string, question string")
    got = {(r["id_a"], r["id_b"]) for r in near_pairs.near_pairs(df, "id", "question").collect()}
    assert got == brute(rows)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, question string, split string, context string")
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_pairs.near_pairs(none, "id", "question").count() == 0
    assert overlap.overlaps(none, "id", "question", overlap.split_side(F.col("split"))).count() == 0
    assert components.stars(components.related(none, "id", [F.col("context")])).count() == 0
    assert encode.encode(docs, "doc_id", "text").count() == 0
    assert leak.leaks(docs, "doc_id", "text", items, "item_id", "text").count() == 0
    assert fold.same_look(docs, "doc_id", "text").count() == 0


# --- 5 ---------------------------------------------------------------------


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(100, 101), (7, 7)]
    df = spark.createDataFrame([(f"{a:04}".encode(), f"{b:04}".encode()) for a, b in links], "u binary, v binary")
    got = {int(r["node"]): int(r["component"]) for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_related_records(spark):
    rows = [("a", "p", None), ("b", "p", "m"), ("c", None, "m"), ("d", "q", None), ("e", None, None), ("e", "q", None), (None, "p", None), ("f", None, None)]
    df = spark.createDataFrame(rows, "id string, x string, y string")
    members = components.related(df, "id", [F.col("x"), F.col("y")])
    assert sorted((r["id_first"], r["id_other"]) for r in components.stars(members).collect()) == [("a", "b"), ("a", "c"), ("d", "e")]
    assert members.count() == 6


def test_splits_keep_components_and_shares(spark):
    rows = [(f"big{i}", "p") for i in range(300)] + [(f"s{i}", f"g{i // 3}") for i in range(900)]
    df = spark.createDataFrame(rows, "id string, x string")
    members = components.cut(components.related(df, "id", [F.col("x")]))
    plans = spark.createDataFrame([("a", "train", 0.6), ("a", "test", 0.4)], "plan_id string, piece string, share double")
    assigned = components.assign(members, plans)
    assert assigned.groupBy("component").agg(F.count_distinct("piece").alias("n")).where("n > 1").count() == 0
    report = {r["piece"]: r["reached"] for r in components.split_report(assigned, plans).collect()}
    assert assigned.count() == 1200 and abs(report["train"] - 0.6) < 0.05


def test_passages_and_manuals(spark):
    df = spark.createDataFrame([("c", "q", "arc", "M"), (None, "A b.\n\nx", "oil_and_gas", "The  Manual!"), (None, "no", "oil_and_gas", "--")], "c string, q string, d string, s string")
    got = df.select(components.passage_of(F.col("c"), F.col("q")).alias("p"), components.manual_of(F.col("d"), F.col("s")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("c", None), ("a b", "the manual"), (None, None)]


# --- 6 ---------------------------------------------------------------------


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(120, 9)
    rows = [(f"q{i:03}", t, rng.choice(["Train ", "test", "VALIDATION", None, "other"])) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, question string, split string")
    found = overlap.overlaps(df, "id", "question", overlap.split_side(F.col("split")), coverage=True).collect()
    side = {i: {"train": 0, "test": 1, "validation": 1}.get((s or "").strip().lower()) for i, _, s in rows}
    text = {i: words(t) for i, t, _ in rows}

    def run(a, b):
        return any(tuple(a[i : i + 5]) in {tuple(b[j : j + 5]) for j in range(len(b) - 4)} for i in range(len(a) - 4))

    want = {p for p in brute([r[:2] for r in rows]) if {side[p[0]], side[p[1]]} == {0, 1}}
    got = {(r["id_a"], r["id_b"]) for r in found}
    # Pairs without a common run of five words are the stated exception.
    assert got <= want and {p for p in want if run(text[p[0]], text[p[1]]) or text[p[0]] == text[p[1]]} <= got
    assert all(0 < r["coverage_a"] <= 1 and 0 < r["coverage_b"] <= 1 for r in found)
    for block in (3, 2048):
        plain = overlap.overlaps(df, "id", "question", overlap.split_side(F.col("split")), block=block)
        assert {(r["id_a"], r["id_b"]) for r in plain.collect()} == got and plain.count() == len(got)
        exact = overlap.overlaps(df, "id", "question", overlap.split_side(F.col("split")), block=block, reordered=True)
        assert sorted((r["id_a"], r["id_b"]) for r in exact.collect()) == sorted(want)


def test_partners_count_the_pairs(spark):
    texts = corpus(80, 11) * 2
    rows = [(f"q{i:03}", t, ["train", "test", None, "Validation"][i % 4]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id string, question string, split string").withColumn("cls", F.lit(1))
    side = overlap.split_side(F.col("split"))
    want = {}
    for r in overlap.overlaps(df, "id", "question", side).collect():
        for end in (r["id_a"], r["id_b"]):
            want[end] = want.get(end, 0) + 1
    got = {r["id"]: r["links"] for r in overlap.partners(df, "id", "question", side).collect()}
    assert {k: v for k, v in got.items() if v} == want and want
    assert set(got) == {i for i, t, s in rows if s and words(t)}


def test_reordered_overlaps(spark):
    a = " ".join(f"w{k}" for k in range(40))
    b, c = " ".join(f"w{k * 7 % 40}" for k in range(40)), " ".join(f"w{k}" + (f" x{k}" if k % 4 == 3 else "") for k in range(40))
    df = spark.createDataFrame([("a", a, "train"), ("b", b, "test"), ("c", c, "test")], "id string, question string, split string")
    side = overlap.split_side(F.col("split"))
    assert overlap.overlaps(df, "id", "question", side).count() == 0
    assert {r["id_b"] for r in overlap.overlaps(df, "id", "question", side, coverage=True, reordered=True).collect()} == {"b", "c"}


def test_alignment():
    a = "a b c d e f g h".split()
    b = "x a b c Y e f g h".split()
    assert overlap.aligned(a, b, [(0, 1), (5, 6)]) == 7
    assert overlap.chain([(0, 5), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]
    assert overlap.chain([]) == []


# --- 8 ---------------------------------------------------------------------

TEXTS = ["", None, "Hello  world\n\n it's 5's", "naïve ☃ 中文 ‍👩‍🏫", "<|endoftext|> a", " \t\n " * 9, "ab12 " * 300, "x" * 3000]


def test_ids_are_those_of_the_other_library(spark):
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(encode.rank_file("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, "again"), (None, "no id")], "doc_id long, text string")
    got = encode.encode(df.withColumn("ids", F.lit("clash")), "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] not in (None, 0):
            t = TEXTS[r["doc_id"]] or ""
            assert list(r["ids"]) == other.encode(t, add_special_tokens=False).ids
            assert encode.decode(r["ids"]) == t


@pytest.mark.parametrize("long", [1, 7, 50])
def test_cutting_long_texts_changes_nothing(long):
    for t in TEXTS:
        if t:
            assert "".join(encode.parts(t, long)) == t
            assert encode.ids_of(t, encode.encoder(), long) == encode.ids_of(t, encode.encoder())


# --- 9 ---------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rng = random.Random(1)
    item = [f"v{rng.randrange(30)}" for _ in range(40)]
    items = [(1, " ".join(item)), (2, "too short"), (3, None), (3, " ".join(f"u{i}" for i in range(12)))]
    docs = [(10, "x " + " - ".join(item[3:15]).upper() + " y"), (11, " ".join(item[3:14])), (12, "v" * 9), (13, None), (14, ""), (15, " ".join(f"u{i}" for i in range(12)).replace("u", "ｕ")), (16, " ".join(item) * 3), (10, "again")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = sorted(tuple(r) for r in leak.leaks(d, "doc_id", "text", i, "item_id", "text").collect())
    assert got == [(10, 1), (15, 3), (16, 1)]
    report = {r["item_id"]: r["documents"] for r in leak.leaked_items(leak.leaks(d, "doc_id", "text", i, "item_id", "text"), i, "item_id", "doc_id").collect()}
    assert report == {1: 2, 2: 0, 3: 1}


@pytest.mark.parametrize("edits,wanted", [(1, 0.95), (2, 0.9)])
def test_leaks_with_edits_reach_their_recall(spark, edits, wanted):
    rng = random.Random(2)
    items, docs, far = [], [], []
    for k in range(300):
        item = [f"w{rng.randrange(5000)}" for _ in range(12)]

        def change(count, item=item):
            copy = list(item)
            for _ in range(count):
                at, kind = rng.randrange(len(copy)), rng.choice(["change", "insert", "leave out"])
                copy[at : at + (kind != "insert")] = [] if kind == "leave out" else [f"new{rng.randrange(10**9)}"]
            return " ".join(copy)

        items.append((k, " ".join(item)))
        docs.append((k, f"before {k} it " + change(edits) + f" and {k} after it come other words than those"))
        # Six words of another place in the middle: no passage is near.
        far.append((1000 + k, " ".join(item[:3] + [f"x{k}y{n}" for n in range(6)] + item[9:])))
    d, i = spark.createDataFrame(docs + far, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in leak.leaks(d, "doc_id", "text", i, "item_id", "text", max_edits=edits, recall=wanted).collect()}
    assert got <= {(k, k) for k in range(300)} and len(got) >= (wanted - 0.03) * 300


def test_distances_equal_the_plain_recursion():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, 6), rng.integers(0, 4, 9)

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, u in enumerate(x, 1):
                new = [i]
                for j, v in enumerate(y, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
                row = new
            return row[-1]

        best = min(distance(a, b[p:q]) for p in range(10) for q in range(p, 10))
        assert leak.distances(a[None], b[None])[0] == best


# --- 10 --------------------------------------------------------------------


def test_fold(spark):
    same = [
        ("é", "é"), ("Å", "Å"), ("ｆｕｌｌ　１２", "full 12"), ("ﬁne ﬂow", "fine flow"), ("a​b﻿­c", "abc"),
        ("a b c d", "a b c d"), ("re‐do‑x", "re-do-x"), ("Аррlе", "Apple"), ("Ηeу", "Hey"), ("ё", "ë"),
        ("q̣̇", "q̣̇"), ("ệ", "ệ"), ("a\r\nb", "a\nb"), ("각", "각"), ("é" * 300, "é" * 300), ("x" + "👩‍🏫" * 70, "x" + "👩‍🏫" * 70), ("e​́", "é"), ("́x", "́x"),
        ("𝐀ɑıᴏօոᎪꓮⲟѵⅠⅼ𝟏", "AaioonAAovIl1"), ("ｶﾞ" * 200, "ガ" * 200), ("a" + "\u0323\u0301" * 1500, "a" + "\u0323\u0301" * 1500), ("x" + "\u0301" * 1001 + "\u0323", "x\u0323" + "\u0301" * 1001),
    ]
    apart = [("É", "é"), ("e", "é"), ("2", "²"), ("a.", "a!"), ("a b", "a  b"), ("👩‍🏫", "👩🏫"), ("a\tb", "a b"), ("ß", "ss"), ("–", "-")]
    flat = [t for pair in same + apart for t in pair] + ["", None, "plain", "​", "x" * 20000 + "é" * 20000]
    df = spark.createDataFrame(list(enumerate(flat)), "doc_id long, text string").withColumn("piece", F.lit(1))
    got = {r["doc_id"]: r["folded"] for r in fold.fold(df, "doc_id", "text").collect()}
    assert len(got) == len(flat)
    for k in range(len(same)):
        assert got[2 * k] == got[2 * k + 1], same[k]
        assert got[2 * k] == unicodedata.normalize("NFC", got[2 * k])
    for k in range(len(same), len(same) + len(apart)):
        assert got[2 * k] != got[2 * k + 1], apart[k - len(same)]
    end = 2 * (len(same) + len(apart))
    assert [got[end + k] for k in range(4)] == ["", None, "plain", ""] and len(got[end + 4]) == 40000


def test_same_look(spark):
    rows = [(1, "café"), (2, "café"), (3, "café"), (4, "cafe"), (5, "​"), (6, "﻿"), (7, None), (8, None), (9, ""), (2, "café")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (1, 1000):
        got = sorted((r["id_a"], r["id_b"]) for r in fold.same_look(df, "doc_id", "text", block).collect())
        assert got == [(1, 2), (2, 3)]


def test_a_long_text_of_many_pieces(spark):
    text = "aé b" * 250_000
    df = spark.createDataFrame([(1, text), (2, unicodedata.normalize("NFD", text)), (3, text + "."), (4, text)], "doc_id long, text string")
    assert fold.fold(df, "doc_id", "text").where(F.length("folded") >= 1_000_000).count() == 4
    assert sorted(tuple(r) for r in fold.same_look(df, "doc_id", "text").collect()) == [(1, 2), (2, 4)]


def test_looks_counts_without_pairs(spark):
    rows = [(1, "café"), (2, "cafe\u0301"), (3, "café"), (4, "cafe"), (5, None), (6, " "), (2, "cafe\u0301"), (7, "caf\u200bé")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("look", F.lit(1))
    got = {r["id"]: (r["look"], r["links"]) for r in fold.looks(df, "doc_id", "text").collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 2, 2: 3, 3: 2, 4: 0, 7: 3}
    assert {got[k][0] for k in (1, 2, 3, 7)} == {1} and got[4][0] == 4


def test_spread_join_is_a_join(spark):
    from sparrowmill.llm.common import spread_join

    left = spark.createDataFrame([(k, "hot" if k % 3 else None if k % 2 else f"c{k}") for k in range(300)], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("c6", 3), (None, 4)], "key string, v int")
    for how in ("inner", "left"):
        want = sorted(str(r) for r in left.join(right, "key", how).select("key", "id", "v").collect())
        for least in (5, 4096):
            assert sorted(str(r) for r in spread_join(left, right, "key", "id", how, least, 16).select("key", "id", "v").collect()) == want


# --- very long texts ---------------------------------------------------------


def test_very_long_texts(spark):
    import time

    began = time.time()
    blanks, many = "a" + " " * 100_000 + "b", " ".join(f"w{i % 5000}" for i in range(30_000))
    texts = [(1, blanks), (2, "x" * 500_000 + "é"), (3, many), (4, "é" * 100_000), (5, "-" * 100_000 + "a"), (6, many + " more")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: len(r["folded"]) for r in fold.fold(docs, "doc_id", "text").collect()} == {i: len(t) for i, t in texts}
    item = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(100, 120)))], "item_id long, text string")
    assert sorted(tuple(r) for r in leak.leaks(docs, "doc_id", "text", item, "item_id", "text").collect()) == [(3, 7), (6, 7)]
    assert {len(r["ids"]) > 0 for r in encode.encode(docs.where("doc_id <> 2"), "doc_id", "text").collect()} == {True}
    q = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("question"), F.when(F.col("doc_id") == 3, "train").otherwise("test").alias("split"))
    assert [(r["id_a"], r["id_b"]) for r in near_pairs.near_pairs(q, "id", "question").collect()] == [("3", "6")]
    assert [(r["id_a"], r["id_b"]) for r in overlap.overlaps(q, "id", "question", overlap.split_side(F.col("split"))).collect()] == [("3", "6")]
    assert time.time() - began < 150
