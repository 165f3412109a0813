"""Defects, truncation, samples and subsets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import allocate, defects, diverse

QUESTION = "Light from Vikovari passes through flexible helium onto gloves. Which property of coral matters most for Vikovari?"
STEP = "Therefore the fern needs more algae than before. The statement about zinc does not fit, so it can be set aside."
PT = "Portanto, a alternativa sobre isso não está de acordo com os dados. Também é preciso considerar que 15 por cento já foram usados."
RESPONSES = [
    (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A", "empty"), ("...", "empty"), ("<think>x</think>", "empty"),
    ("__ERROR__ timed out", None),
    (STEP + "\nFINAL ANSWER: B", None), (STEP + " So the answer is A.", None), (STEP + "\n**C**", None), (STEP + "\nChoice (A)", None),
    (STEP + "\n- only frugal bakers ✔", None), (STEP + "\n```\nresult = 44\n```", None), (STEP + " No single option stands out clearly.", None),
    ("FINAL ANSWER: 4.", None), (STEP + '\nShe said "yes."', None),
    (STEP + " Next, compare Peris with the gard", "truncated"), (STEP + " Next, compare…", "truncated"), (STEP + "\nFINAL ANS", "truncated"),
    (STEP + "\nFINAL ANSWER:", "truncated"), (STEP + "\n**FINAL ANSWER: B", "truncated"), ("<think>\n" + STEP, "truncated"),
    (STEP + "\n<think>Because it is done.", "truncated"), (STEP + " [truncated]", None), (STEP + " Option B", "truncated"), (STEP + " Next, compare [truncated]", "truncated"),
    (STEP + "\n```\nresult = 4", "truncated"), ("The question says: Light from Vikovari passes through flexible hel", "truncated"),
    (QUESTION, "copy"), ("Question: " + QUESTION, "copy"), (QUESTION + "\n\nOptions:\nA) only tin\nB) oxygen 490", "copy"), (QUESTION.lower().replace("flexible ", ""), "copy"),
    ("The question says: " + QUESTION + " " + STEP + " No single option stands out clearly.", None),
    ("I'm sorry, but I can't help with this question.", "refusal"), ("Hmm. My guidelines prevent me from discussing the mugs of Danimamo.", "refusal"),
    ("Prefiro não responder a esta questão.", "refusal"), ("I apologize, but I have to pass on questions involving zinc.", "refusal"),
    ("I cannot rule out zinc yet, so the depth has to be checked. Sorry, that line was wrong.", None),
    ("I'm sorry, but I can't help much. Still, " + STEP + "\nFINAL ANSWER: B", None),
    (PT + "\nFINAL ANSWER: A", "other_language"), ("首先，有物品，需要减去一部分。因此只剩下单位。\nFINAL ANSWER: A", "other_language"),
    ("Сначала заметим, что это имеет предметов. Поэтому остаётся только десять единиц.\nFINAL ANSWER: B", "other_language"), (PT + " Depois som", "other_language"),
]


@pytest.fixture(scope="module")
def tables(spark):
    n = len(RESPONSES)
    rows = [(k, "q1", "m", "r", 10 + k % 7, t) for k, (t, _) in enumerate(RESPONSES)]
    rows += [(n, "pt", "m", "r", 5, PT + "\nFINAL ANSWER: A"), (n + 1, "pt", "m", None, None, STEP + "\nFINAL ANSWER: A"), (n + 2, "gone", None, "r", None, STEP), (n + 3, None, "m", "r", 1, QUESTION)]
    responses = spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string").withColumns({"words": F.lit(1), "text": F.lit("clash")})
    kind = "id string, question string, choices struct<label: array<string>, text: array<string>>"
    pt = "O supervisor suspeita de vapor misturado com cimento. Que medida protege melhor o medidor contra a corrosão da válvula?"
    questions = spark.createDataFrame([("q1", QUESTION, (["A", "B"], ["only tin", "oxygen 490"])), ("q1", QUESTION, (["A", "B"], ["only tin", "oxygen 490"])), ("pt", pt, None), ("null", None, None), (None, "x", None)], kind)
    return responses, questions


def test_defects(spark, tables):
    got = {r["rec_id"]: r["defect"] for r in defects.settled(defects.cut(defects.classify(*tables))).collect()}
    assert len(got) == len(RESPONSES) + 4
    wrong = [(t, d, got[k]) for k, (t, d) in enumerate(RESPONSES) if got[k] != d]
    assert not wrong
    n = len(RESPONSES)
    assert [got[n + k] for k in range(4)] == [None, "other_language", None, None]


def test_long_responses(spark, tables):
    texts = [(1, " " * 300_000), (2, "a" + " " * 300_000 + "b."), (3, "-" * 300_000), (4, "-" * 300_000 + "a"), (5, "word " * 100_000 + "end."), (6, "<think>" * 50_000)]
    rows = [(k, "q1", "m", "r", 1, t) for k, t in texts]
    responses = spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string")
    got = {r["rec_id"]: r["defect"] for r in defects.settled(defects.cut(defects.classify(responses, tables[1]))).collect()}
    assert got == {1: "empty", 2: None, 3: "empty", 4: "truncated", 5: None, 6: "truncated"}


def test_recurring_templates_without_an_answer_are_refusals(spark):
    # Nothing in these words declines; they recur over prompts and never with an answer.
    rows = [(k, f"q{k}", "m", "r", 9, "Kindly consult the nearest office for matters of this kind.") for k in range(30)]
    rows += [(100 + k, f"q{k}", "m", "r", 9, f"First we list facts about item {k}, then we add them." + ("\nFINAL ANSWER: A" if k % 10 else "")) for k in range(60)]
    responses = spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string")
    questions = spark.createDataFrame([], "id string, question string, choices struct<label: array<string>, text: array<string>>")
    got = {r["rec_id"]: r["defect"] for r in defects.classify(responses, questions).collect()}
    assert {got[k] for k in range(30)} == {"refusal"} and {got[100 + k] for k in range(60)} == {None}


def test_templates_count_prompts_not_rows(spark):
    kind = "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string"
    questions = spark.createDataFrame([], "id string, question string, choices struct<label: array<string>, text: array<string>>")
    answered = [(100 + k, f"q{k}", "m", "r", 9, f"First we list facts about item {k}, then we add them.\nFINAL ANSWER: A") for k in range(400)]
    # A few rows over as many prompts are enough; many rows of one prompt are not.
    few = [(k, f"q{k}", "m", "r", 9, "Kindly consult the nearest office for matters of this kind.") for k in range(8)]
    one = [(10 + k, "q1" if k else "q2", "m", "r", 9, "Please see the leaflet that came with the parcel.") for k in range(31)]
    # Two templates with one band key in common have leaders of their own.
    long = [(50 + k, f"q{k}", "m", "r", 9, "Kindly consult the nearest office for matters of " + "every other sort " * 30 + ".") for k in range(8)]
    rows = spark.createDataFrame(answered + few + one + long, kind)
    got = {r["rec_id"]: (r["defect"], r["found_by"]) for r in defects.classify(rows, questions).collect()}
    assert {got[k] for k in [*range(8), *range(50, 58)]} == {("refusal", "cluster")}
    assert {got[k] for k in [*range(10, 41), *range(100, 500)]} == {(None, None)}


def test_a_band_has_as_many_leaders_as_it_takes(spark):
    # Eight clusters in one band: each has 5 bigrams of its own beside those all share.
    rows = [(band, 100 * n + m, 50 - n, 0, int(m < 2), [1, 2, *range(10 * n + 10, 10 * n + 14), 1000 + 100 * n + m]) for band in (1, 2) for n in range(8) for m in range(4)]
    rows += [(1, 9000, 99, 0, 0, [1, 2, 10, 11, 12, 13, 5]), (1, 9001, 99, 0, 0, [7, 8]), (3, 9002, 99, 0, 0, [1, 2])]
    df = spark.createDataFrame(rows, "band long, opening long, prompts long, k long, c int, grams array<long>")
    got = {(r["band"], r["opening"]): r["leader"] for r in defects.stars(df).collect()}
    assert got == {(b, 100 * n + m): 100 * n + 1 for b in (1, 2) for n in range(8) for m in range(4)} | {(1, 9000): 1}


def test_all_templates_of_a_band_are_found(spark):
    # The openings share the bigrams with the least hashes, so they meet in a band; there are seven clusters and no phrase that declines.
    heads = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "gum"]
    grams = lambda n: sorted([1, 2, *range(100 * n + 100, 100 * n + 103)])
    rows = [(f"q{k}", False, True, n, grams(n)) for n in range(len(heads)) for k in range(30 + n)]
    rows += [(f"q{k}", True, False, 1000 + k, [10_000 + k]) for k in range(400)]
    df = spark.createDataFrame(rows, "id string, answered boolean, candidate boolean, opening long, grams array<long>")
    keep, defects.band_keys = defects.band_keys, lambda: F.array(F.lit(1).cast("long"))
    try:
        assert {r["opening"] for r in defects.templates(df).collect()} == set(range(len(heads)))
    finally:
        defects.band_keys = keep


def test_refusals_behind_three_leaders_are_not_truncated(spark):
    # They end behind a digit and a point, and at the length at which texts are cut, so that the length would decide.
    tails = ["alder birch", "cedar dogwood", "elm fir", "gum hazel", "ironwood juniper"]
    texts = ["Kindly note the office " + t + f" desk {k}." for k, t in enumerate(tails)]
    kind = "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string"
    rows = [(100 * n + k, f"q{k}", "m", "r", 90, t) for n, t in enumerate(texts) for k in range(40)]
    rows += [(1000 + k, f"q{k}", "m", "r", 20 + k % 60, STEP + "\nFINAL ANSWER: B") for k in range(600)]
    rows += [(2000 + k, f"q{k}", "m", "r", 90, STEP + " Next, compare Peris with the gard") for k in range(150)]
    questions = spark.createDataFrame([], "id string, question string, choices struct<label: array<string>, text: array<string>>")
    keep, defects.band_keys = defects.band_keys, lambda: F.array(F.lit(1).cast("long"))
    try:
        got = defects.settled(defects.cut(defects.classify(spark.createDataFrame(rows, kind), questions)))
        assert {r["rec_id"] for r in defects.truncated(got).collect()} == set(range(2000, 2150))
    finally:
        defects.band_keys = keep


def test_an_opening_counts_for_each_leader_it_is_like(spark):
    rows = [(1, 1, 50, 0, 1, [1, 2, 3, 4, 5, 6]), (1, 2, 40, 0, 1, [3, 4, 5, 6, 7, 8, 9, 10]), (1, 3, 30, 0, 0, [2, 3, 4, 5, 6, 7, 8]), (1, 4, 20, 0, 0, [7, 8, 9, 10])]
    df = spark.createDataFrame(rows, "band long, opening long, prompts long, k long, c int, grams array<long>")
    got = sorted((r["leader"], r["opening"]) for r in defects.stars(df).collect())
    assert got == [(1, 1), (1, 3), (2, 2), (2, 3), (2, 4)]


def test_clusters_around_all_leads_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(9)) ** 2 // 9, n, int(rng.integers(1, 9)), int(rng.integers(5)), int(rng.random() < 0.4), int(rng.random() < 0.5)) for n in range(600)]
    rows = [(*r, sorted({int(g) for g in rng.integers(0, 12, 8)})) for r in rows]
    df = spark.createDataFrame(rows, "band long, opening long, prompts long, k long, lead int, rest int, grams array<long>")
    like = lambda a, b: len({*a} & {*b}) >= 0.5 * len({*a} | {*b})
    pairs = [(x, y) for x in rows for y in rows if x[4] and x[0] == y[0] and like(x[6], y[6])]
    sums = {}
    for x, y in pairs:
        old = sums.get((x[0], x[1]), (0, 0, 0))
        sums[x[0], x[1]] = (old[0] + y[2], old[1] + y[3], old[2] + y[5])
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    keep = spark.conf.get(batch)
    try:
        for size in (7, 10_000):
            spark.conf.set(batch, size)
            got = [(r["band"], r["leader"], r["opening"], r["prompts"], r["k"]) for r in defects.around(df, pairs=True).collect()]
            assert sorted(got) == sorted((x[0], x[1], *y[1:4]) for x, y in pairs)
            assert {(r["band"], r["leader"]): (r["prompts"], r["k"], r["rest"]) for r in defects.around(df).collect()} == sums
    finally:
        spark.conf.set(batch, keep)


def test_every_candidate_leads_a_cluster(spark):
    # 1 has the most prompts and is like answered ones, 2 is like 1 alone; 3 is like 4 and 5, which are not like each other or templates by themselves.
    sets = {1: range(3, 10), 2: range(5, 12), 9: range(1, 8), 3: range(105, 112), 4: range(103, 110), 5: range(107, 114), 8: range(101, 108)}
    asked = {1: 45, 2: 40, 3: 3, 4: 4, 5: 3}
    rows = [(f"q{10 * n + k}", False, True, n, list(sets[n])) for n, m in asked.items() for k in range(m)]
    rows += [(f"q{k}", True, False, n, list(sets[n])) for n in (8, 9) for k in range(300)]
    # Many openings of one prompt are no template.
    rows += [("q1", False, True, 50 + k, [201, 202, 203, 204, 300 + k]) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, answered boolean, candidate boolean, opening long, grams array<long>")
    keep, defects.band_keys = defects.band_keys, lambda: F.array(F.lit(1).cast("long"))
    try:
        assert {r["opening"] for r in defects.templates(df).collect()} == {1, 2, 3, 4, 5}
    finally:
        defects.band_keys = keep


def test_refusals_like_an_answered_leader_are_not_truncated(spark):
    # The leader with the most prompts is like openings with answers, the refusals are like this leader alone.
    words = "alder birch cedar dogwood elm fir gum hazel ironwood juniper kauri larch".split()
    text = lambda at, end: " ".join(words[at : at + 8]) + end
    kind = "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string"
    rows = [(k, f"q{k}", "m", "r", 90, text(2, " desk 3.")) for k in range(45)] + [(100 + k, f"q{k}", "m", "r", 90, text(4, " desk 4.")) for k in range(40)]
    rows += [(1000 + k, f"q{k}", "m", "r", 20 + k % 60, text(0, ".\nFINAL ANSWER: B")) for k in range(600)]
    rows += [(2000 + k, f"q{k}", "m", "r", 90, STEP + " Next, compare Peris with the gard") for k in range(150)]
    questions = spark.createDataFrame([], "id string, question string, choices struct<label: array<string>, text: array<string>>")
    keep, defects.band_keys = defects.band_keys, lambda: F.array(F.lit(1).cast("long"))
    try:
        got = defects.settled(defects.cut(defects.classify(spark.createDataFrame(rows, kind), questions)))
        assert {r["rec_id"] for r in defects.truncated(got).collect()} == set(range(2000, 2150))
    finally:
        defects.band_keys = keep


def test_long_and_late_refusals(spark, tables):
    texts = [STEP + " " + "The zinc stays where it is. " * 30 + "I'm sorry, but I can't help with this question.", "I cannot provide an answer here. " + "It is a matter of zinc and coral. " * 12]
    assert len(texts[0]) > 400 and len(texts[1].split()) > 61
    rows = [(k, "q1", "m", "r", 1, t) for k, t in enumerate(texts)]
    got = defects.classify(spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string"), tables[1])
    assert [(r["defect"], r["found_by"]) for r in got.collect()] == [("refusal", "phrase")] * 2


def test_copies_of_short_questions_and_with_a_tail(spark, tables):
    kind = "id string, question string, choices struct<label: array<string>, text: array<string>>"
    questions = tables[1].unionByName(spark.createDataFrame([("short", "Why zinc?", None)], kind))
    rows = [(0, "short", "Why zinc?"), (1, "short", "Why zinc is rare?"), (2, "q1", QUESTION + " (one answer only)"), (3, "q1", "Question: " + QUESTION[:-12])]
    rows = [(k, i, "m", "r", 1, t) for k, i, t in rows]
    got = defects.settled(defects.cut(defects.classify(spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string"), questions)))
    assert {r["rec_id"]: r["defect"] for r in got.collect()} == {0: "copy", 1: None, 2: "copy", 3: "truncated"}


def test_the_length_decides_open_endings(spark, tables):
    rows = [(k, "q1", "m", "r", 20 + k % 60, STEP + "\nFINAL ANSWER: B") for k in range(600)]
    rows += [(2000 + k, "q1", "m", "r", 90, STEP + " Next, compare Peris with the gard") for k in range(150)]
    rows += [(1300, "q1", "m", "r", 90, STEP + " The rate is 43."), (1301, "q1", "m", "r", 40, STEP + " The rate is 43."), (1302, "q1", "m", "r", 90, STEP + " Here (again)"), (1303, "q1", "m", "r", 40, STEP + " Here (again)")]
    responses = spark.createDataFrame(rows, "rec_id long, id string, model string, run_id string, gen_tokens int, raw_response string")
    classified = defects.cut(defects.classify(responses, tables[1]))
    got = {r["rec_id"]: r["defect"] for r in defects.settled(classified).collect()}
    # Equal endings, told apart by the fitted limit alone.
    assert [got[k] for k in (1300, 1301, 1302, 1303)] == ["truncated", None, "truncated", None]
    assert {got[k] for k in range(600)} == {None} and {got[2000 + k] for k in range(150)} == {"truncated"}


def test_truncated_and_report(spark, tables):
    classified = defects.cut(defects.classify(*tables))
    settled = defects.cut(defects.settled(classified))
    assert settled.count() == classified.count()
    found = defects.truncated(settled)
    report = defects.truncation_report(settled)
    assert report.agg(F.sum("responses"), F.sum("truncated")).first()[:] == (classified.count(), found.count())
    assert {r["defect"] for r in defects.defect_report(settled).collect()} == {"empty", "truncated", "copy", "refusal", "other_language"}
    empty = classified.limit(0)
    assert defects.settled(empty).count() == 0 and defects.truncation_report(settled.limit(0)).count() == 0


def test_censored_fit_finds_the_parameters():
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(5, 0.5, 20_000))
    limit = 180
    length = np.minimum(np.ceil(x), limit).astype(int)
    seen = np.bincount(length[x <= limit], minlength=limit + 1)[1:].astype(float)
    cut = np.zeros(limit)
    cut[-1] = (x > limit).sum()
    mu, sd = defects.fit_censored(np.arange(1, limit + 1, dtype=float), seen, cut, 300)
    assert abs(mu - 5) < 0.03 and abs(sd - 0.5) < 0.03


def test_limits_find_the_cap(spark):
    rows = [("m", "r", n, 5, 0) for n in range(20, 100)] + [("m", "r", 100, 1, 200), ("m", "r", None, 3, 3)]
    got = {r["gen_tokens"]: r["odds"] for r in defects.limits(spark.createDataFrame(rows, "model string, run_id string, gen_tokens int, seen long, cut long")).collect()}
    assert len(got) == 82 and got[100] > got[50] and all(abs(v) <= 6 for v in got.values())


# --- 3 ---------------------------------------------------------------------


def test_quotas_pass_to_siblings_first():
    shares = np.array([0.25, 0.25, 0.5])
    parent = np.array(["x", "x", "y"])
    assert allocate.quotas(100, shares, np.zeros(3, int), np.array([10, 100, 100]), parent).tolist() == [10, 40, 50]
    assert allocate.quotas(100, shares, np.zeros(3, int), np.array([10, 30, 100]), parent).tolist() == [10, 30, 60]
    assert allocate.quotas(100, shares, np.zeros(3, int), np.array([1, 2, 3]), parent).tolist() == [1, 2, 3]
    assert allocate.quotas(10, np.array([0.01, 0.99]), np.array([3, 0]), np.array([50, 50]), np.array(["x", "y"])).tolist() == [3, 7]


def test_quotas_go_down_the_tree():
    parent = np.array(["x", "x", "x", "y", "y"])
    shares, none, many = np.array([0.1, 0.1, 0.1, 0.35, 0.35]), np.zeros(5, int), np.full(5, 1000)
    # 5 rows: 1.5 and 3.5 for the datasets make 2 and 3 of them, and only then whole rows of their targets.
    got = allocate.quotas(5, shares, none, many, parent)
    assert got[:3].sum() == 2 and got[3:].sum() == 3
    # A minimum takes from its siblings before it takes from cousins.
    got = allocate.quotas(100, shares, np.array([20, 0, 0, 0, 0]), many, parent)
    assert got.tolist() == [20, 5, 5, 35, 35]
    got = allocate.quotas(100, shares, np.array([40, 0, 0, 0, 0]), many, parent)
    assert got.tolist() == [40, 0, 0, 30, 30]
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        parent, shares = rng.choice(list("abc"), n), rng.random(n) * (rng.random(n) > 0.2)
        least, room, size = rng.integers(0, 6, n), rng.integers(0, 30, n), int(rng.integers(0, 90))
        got = allocate.quotas(size, shares, least, room, parent)
        assert (got >= 0).all() and (got <= room).all() and (got >= np.minimum(least, room)).all()
        most = max(size, int(least.sum())) if shares.sum() > 0 else int(least.sum())
        assert got.sum() == min(most, int(room.sum()))


def test_sample(spark):
    rows = [(f"a{k}", "D", "S One") for k in range(60)] + [(f"b{k}", "d", "s-two") for k in range(5)] + [(f"c{k}", "e", None) for k in range(35)] + [("a0", "D", "S One"), (None, "d", "s one")]
    records = spark.createDataFrame(rows, "id string, dataset string, subject string").withColumn("cell", F.lit(1))
    goals = [("p", 0.5, "d", "s one", 0.4, 1), ("p", 0.5, "d", "s two", 0.4, 2), ("p", 0.5, "e", None, 0.2, 2)]
    targets = spark.createDataFrame(goals, "plan_id string, sample_frac double, dataset string, subject string, target_share double, min_rows int")
    goal, members, total = allocate.cells(records, targets)
    allocated = allocate.allocation(goal, members, total)
    drawn = [(r["cell"], r["id"], r["rank"]) for r in allocate.sample(members, allocated).collect()]
    counts = {c: sum(x[0] == c for x in drawn) for c in {x[0] for x in drawn}}
    assert counts == {"d/s one": 35, "d/s two": 5, "e": 10} and len({x[1] for x in drawn}) == 50
    assert sorted(x[2] for x in drawn if x[0] == "e") == list(range(1, 11))
    # The number of buckets changes nothing.
    assert sorted(drawn) == sorted((r["cell"], r["id"], r["rank"]) for r in allocate.sample(members, allocated, buckets=3).collect())
    unmet = {r["subject"]: r["reason"] for r in allocate.report(allocated).where("NOT met").collect()}
    assert unmet == {"s two": "too few rows"}
    nothing = allocate.cells(records.limit(0), targets)
    assert allocate.report(allocate.allocation(*nothing)).where("drawn > 0").count() == 0


# --- 4 ---------------------------------------------------------------------


def test_greedy_is_the_greedy_determinant():
    x = np.random.default_rng(2).standard_normal((12, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    order, gains = diverse.greedy(x, 6, 5.0)
    kernel, chosen = np.eye(12) + 5.0 * x.astype(float) @ x.T.astype(float), []
    for step in range(6):
        value = {j: np.linalg.slogdet(kernel[np.ix_(chosen + [j], chosen + [j])])[1] for j in range(12) if j not in chosen}
        assert value[order[step]] > max(value.values()) - 1e-4
        chosen.append(int(order[step]))
    assert abs(gains.sum() - np.linalg.slogdet(kernel[np.ix_(chosen, chosen)])[1]) < 1e-3


def test_subset_covers_groups(spark):
    rng = np.random.default_rng(0)
    rows = [(f"hot{k}", "alpha beta gamma delta epsilon zeta eta " + f"n{k}") for k in range(300)]
    rows += [(f"r{k}", " ".join(f"w{rng.integers(3000)}" for _ in range(9))) for k in range(95)] + [("null", None), ("blank", "!!"), ("hot0", rows[0][1]), (None, "x"), ("copy", rows[0][1])]
    df = spark.createDataFrame(rows, "id string, question string").withColumn("words", F.lit(1))
    plans = spark.createDataFrame([("small", 0.05), ("large", 0.2), ("all", 1.0)], "plan_id string, share double")
    got = diverse.choose(df, "id", "question", plans, block=64).collect()
    by = {p: {r["id"] for r in got if r["plan_id"] == p} for p in ("small", "large", "all")}
    total = 398
    assert {p: len(v) for p, v in by.items()} == {"small": 20, "large": 80, "all": total} and by["small"] <= by["large"]
    # Three quarters of all rows are near copies of one text; few of them are chosen.
    assert sum(i.startswith("hot") for i in by["large"]) <= 16
    assert diverse.choose(df.limit(0), "id", "question", plans).count() == 0
    assert diverse.choose(df, "id", "question", plans.limit(0)).count() == 0


def logdet(x):
    return np.linalg.slogdet(np.eye(x.shape[1]) + diverse.STRENGTH * x.T @ x)[1]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_pass_in_parts_is_the_whole_pass(width):
    x = np.random.default_rng(4).standard_normal((200, 30))
    order, gains = diverse.greedy(x.astype(np.float32), 40)
    got, more, inverse = diverse.proceed(x, 15, np.eye(30), width=width)
    rest = np.setdiff1d(np.arange(200), got)
    last, end, _ = diverse.proceed(x[rest], 25, inverse, width=width)
    assert [*got, *rest[last]] == order.tolist()
    assert np.allclose([*more, *end], gains, atol=1e-3)


def test_what_others_can_have_falls_with_the_pass():
    x = np.random.default_rng(9).standard_normal((4000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, _, inverse = diverse.proceed(x[:400], 400, np.eye(8))
    rest = x[400:]
    value = diverse.quadratic(rest, inverse)
    pool = np.sort(np.argsort(-value)[:1800])
    floor = np.delete(value, pool).max()
    whole, _, _ = diverse.proceed(rest, 900, inverse)
    part, gains, after = diverse.proceed(rest[pool], 900, inverse, floor)
    # The part goes on below the old floor, and as far as it goes it is the whole pass.
    assert gains[-1] < np.log1p(diverse.STRENGTH * floor)
    assert pool[part].tolist() == whole[: len(part)].tolist()
    assert (diverse.quadratic(x, after) <= diverse.decay(inverse, after) * diverse.quadratic(x, inverse)).all()


def test_subset_is_one_pass_over_all_core_sets(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{k % 12}w{i}" for i in range(7)) + f" n{k} m{rng.integers(40)}" for k in range(400)]
    texts += [" ".join(f"w{i}" for i in rng.integers(0, 900, 8)) for _ in range(200)]
    df = spark.createDataFrame([(f"q{k:03}", t) for k, t in enumerate(texts)], "id string, question string")
    plans = spark.createDataFrame([("p", 0.2)], "plan_id string, share double")
    counts = np.zeros(diverse.COUNTS)
    bags = [sorted(set(t.split())) for t in texts]
    for bag in bags:
        np.add.at(counts, diverse.bucket(bag) % diverse.COUNTS, 1)
    x = diverse.vectors(bags, counts, len(texts)).astype(float)
    best = logdet(x[diverse.greedy(x.astype(np.float32), 120)[0]])
    found = []
    for work in (16, 10_000):
        got = diverse.choose(df, "id", "question", plans, block=32, work=work).orderBy("rank").collect()
        found.append([r["id"] for r in got])
        at = [int(r["id"][1:]) for r in got]
        assert len(set(at)) == 120 and logdet(x[at]) > 0.98 * best
        # The gains are those of the whole subset, not of parts of it.
        assert abs(sum(r["gain"] for r in got) - logdet(x[at])) < 1e-6
    assert found[0] == found[1]
