"""Defects of prompt and response pairs, and responses that stop before their end.

Only text outside ``<think>`` blocks counts, except for a cut. Each response is
read once, by built-in expressions:

* *empty*: null, nothing visible, or a placeholder for a missing value.
* *copy*: the question's words and hardly any others, with or without the
  options, ending as the question or its options do.
* *refusal*: no answer, and an opening that recurs across unrelated prompts but
  hardly ever before an answer. Openings are
  clustered by MinHash: band keys over word bigrams gather them, each candidate of a
  band leads a cluster of all that Jaccard similarity verifies to be like it, and
  responses, answers and distinct prompts are counted per cluster. A cluster is a refusal if its prompts could
  not all have gone unanswered by chance, given the share of answers in the whole table. Openings
  too rare for that are refusals if the text declines in so many words, by a fixed list of phrases.
* *other_language*: more function words, or letters of the script, of another
  language than the question's.
* *truncated*: the ending and the length together say so. A text that does not end at the end of a
  sentence, of an answer line, of a code block or of a think block is cut; where the ending leaves it
  open, the posterior of the length decides.

The first that holds in this order is the record's defect; runner errors have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lists, mixed, spread_join, within, word_sequence

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the and of is to that for with by not as from are we this was but what which so has have on at in",
    "pt": "não são está que uma um com para isso também assim mais já por como foram do da dos das em os ao até",
    "es": "que el una los las con para por esto así más hay como del año además entre según queda solamente es se y",
    "fr": "est que les des une pour il elle cela avec plus donc après cette pas du et en au aux on qui ne la le",
    "de": "der die das und nicht ist wir mit zu den dass von ein eine für nur auch durch also zum im sich oder",
    "it": "che non il di una per sono gli della con è anche più questo come dei alla nel si le",
}
# Words that may stand around a copied question.
AROUND = (
    "question the you asked options option choices choice choose select one only best answer following here is "
    "original prompt says repeat please a b c d e f 1 2 3 4 5 6 exactly pergunta questão opções opcoes alternativas escolha"
)
# Phrases that decline.
DECLINES = (
    r"(?iU)\b(?:(?:can ?not|can['’]?t|could not|unable to|not able to|won['’]t be able to|will not|won['’]t|would rather not|"
    r"['’]d rather not|must decline to|have to decline to|refuse to|not comfortable|do not feel comfortable|"
    r"don['’]t feel comfortable|inappropriate for me to|not allowed to|not permitted to|no permission to|"
    r"lack the ability to)\s+(?:\w+\s+){0,2}?(?:help|assist|answer|respond|provide|choose|pick|select|solve|give|giving|discuss|"
    r"discussing|comply|offer|advise|attempt|do|complete|share|answering)|not something I can\b|beyond what I am\b|"
    r"(?:guidelines|policies|policy|rules) (?:prevent|forbid|prohibit|do not allow)\b|have to pass on\b|"
    r"no answer can be given\b|as an? (?:AI|language model)\b[^.]*\b(?:not|n['’]t)\b|"
    r"(?:não|nao) (?:posso|consigo|tenho permissão|é possível|devo|vou)\b[^.]*\b(?:ajudar|responder|escolher|resolver|fornecer|dar|discutir)|"
    r"prefiro não|recuso|no puedo (?:ayudar|responder|elegir|contestar)|prefiero no|je ne (?:peux|puis) pas|je préfère ne pas|"
    r"ich kann (?:\w+\s+){0,4}nicht (?:helfen|antworten|beantworten)|не могу (?:помочь|ответить|выбрать)|我(?:不能|无法))"
)
ERROR = "__ERROR__"
#: The look behind keeps long runs of blanks inside a text from being tried again at each of their places.
EDGES = r"\A[\s\p{Z}\p{Cf}\p{Cc}]++|(?<![\s\p{Z}\p{Cf}\p{Cc}])[\s\p{Z}\p{Cf}\p{Cc}]++\z"
PLACEHOLDER = (
    r"(?iU)\A[\W_]*+(?:n\s*/?\s*a|null|none|nil|nan|undefined|empty|blank|missing|tbd|"
    r"no (?:answer|response|output|text|data)|not (?:available|applicable))?[\W_]*+\z"
)
#: What may follow a cut.
CUT_MARK = r"(?i)(?:\s|…|\.{2,}|\x{FFFD}|[\[(<]\s*(?:\.\.\.|…|truncated|cut|continued|max)[^\])>]*[\])>])+$"
#: Logarithms of the odds of a cut: where the ending settles it, and where it leaves it open (behind a digit and
#: a point, which may be half of a number; behind a bracket or quotation mark that closes no sentence).
SURE, POINT, BRACKET = 14.0, -1.0, 1.0
CLOSERS = r"[\"'”’»)\]}*_`]*"
#: The patterns of answers are for texts in lower case.
LABEL = r"(?:[a-j]|[+-]?\d[\d.,]*)"
ANSWER_WORDS = (
    r"(?:answer|resposta|respuesta|réponse|reponse|antwort|risposta|ответ|答案)(?:\s+(?:final|finale|is|é|es|est|ist))?"
)
ANSWER_END = (
    rf"(?:{ANSWER_WORDS}\s*[:：]?\s*(?:\(\s*{LABEL}\s*\)|\*\*{LABEL}\*\*|{LABEL})|"
    rf"(?:option|choice|opção|opción)\s+(?:is\s+{LABEL}|(?:is\s+)?\(\s*{LABEL}\s*\)))\s*[.!]?\s*(?:\*\*)?\z"
)
BARE_END = rf"(?:\A|\n)\s*(?:\*\*\s*{LABEL}\s*\*\*|\(\s*{LABEL}\s*\))\s*\.?\z"


def language(words: Column, text: Column) -> Column:
    """The language with the most function words, by script for others; null without evidence."""
    scripts = (
        F.when(text.rlike(r"[\x{4E00}-\x{9FFF}](?s:.*)[\x{4E00}-\x{9FFF}](?s:.*)[\x{4E00}-\x{9FFF}](?s:.*)[\x{4E00}-\x{9FFF}]"), "zh")
        .when(text.rlike(r"(?s)(?:[\x{0430}-\x{044F}]{2}.*){6}"), "ru")
        .when(text.rlike(r"(?s)(?:[\x{0600}-\x{06FF}]{2}.*){6}"), "ar")
    )
    hits = lambda w: F.size(F.array_intersect(words, F.array(*map(F.lit, w.split()))))
    english = hits(FUNCTION_WORDS["en"])
    others = {c: w for c, w in FUNCTION_WORDS.items() if c != "en"}
    any_other = hits(" ".join(dict.fromkeys(" ".join(others.values()).split())))
    counts = F.array(
        F.struct(english.alias("n"), F.lit(0).alias("o"), F.lit("en").alias("c")),
        *(F.struct(hits(w).alias("n"), F.lit(-k).alias("o"), F.lit(c).alias("c")) for k, (c, w) in enumerate(others.items(), 1)),
    )
    best = F.array_max(counts)
    # No language can have more words than all of them together, and English goes first.
    latin = F.when((english >= 2) & (any_other <= english), "en").otherwise(F.when(best["n"] >= 2, best["c"]))
    return F.when(text.rlike(r"[^\x00-\x{024F}]"), F.coalesce(scripts, latin)).otherwise(latin)


def visible(raw: Column) -> tuple[Column, Column]:
    """``(text outside think blocks, whether a think block is open at the end)``."""
    # An open block reaches to the end, so that no place is read twice.
    rest = F.when(raw.contains("<think>"), F.regexp_replace(raw, r"(?s)<think>.*?(?:</think>|\z)", "")).otherwise(raw)
    return F.regexp_replace(rest, "</think>", ""), F.substring_index(raw, "</think>", -1).contains("<think>")


def read(responses: DataFrame) -> DataFrame:
    """The responses with what can be told from each alone."""
    raw = F.col("raw_response")
    seen, opened = visible(raw)
    rows = responses.select(
        "rec_id", "id", "model", "run_id", "gen_tokens", raw.alias("raw"), seen.alias("_seen"), opened.alias("_open")
    ).withColumn("text", F.regexp_replace("_seen", EDGES, ""))
    # A cut, an answer line and its mark are all told from the end.
    tail = F.right("text", F.lit(96))
    rows = rows.withColumn("_tail", F.regexp_replace(tail, CUT_MARK, "")).withColumn(
        "_line", F.substring_index("_tail", "\n", -1)
    )
    fences = F.when(F.col("text").contains("```"), F.regexp_count("text", F.lit("```")) % 2 == 1).otherwise(F.lit(False))
    end = F.lower(F.right("_tail", F.lit(56)))
    answer = end.rlike(ANSWER_END) | end.rlike(BARE_END)
    half_bold = F.col("_line").rlike(r"^\s*\*\*(?:(?!\*\*).)*$")
    sentence = F.right("_tail", F.lit(16)).rlike(rf"[.!?。！？؟।]{CLOSERS}\z")
    mark = F.col("_tail").rlike(r"(?:[✓✔✅☑]|```)\s*\z")
    whole = (((sentence | answer) & ~half_bold) | mark) & ~fences
    shut = F.right("_tail", F.lit(16)).rlike(r"[\p{L}\p{N}][)\]\"”’»]+\z") & ~half_bold
    point = F.right("_tail", F.lit(2)).rlike(r"[0-9]\.\z") & ~answer
    ending = (
        F.when(F.coalesce(F.col("_open"), F.lit(False)), SURE)
        .when(fences | F.col("_tail").isNull(), F.when(F.col("_tail").isNull(), -SURE).otherwise(SURE))
        .when(whole, F.when(point & ~mark, POINT).otherwise(-SURE))
        .otherwise(F.when(shut, BRACKET).otherwise(SURE))
    )
    return rows.select(
        "rec_id",
        "id",
        "model",
        "run_id",
        "gen_tokens",
        "text",
        F.coalesce(F.col("raw").startswith(ERROR), F.lit(False)).alias("error"),
        (F.col("raw").isNull() | (F.col("text").rlike(PLACEHOLDER) & ~F.col("_open"))).alias("empty"),
        F.coalesce(answer | mark, F.lit(False)).alias("answered"),
        F.coalesce(ending, F.lit(-SURE)).alias("ending"),
    )


def asked(questions: DataFrame, *more: DataFrame) -> DataFrame:
    """``id, q_words, o_words, q_lang, q_last`` for each question; repeated ids are one question."""
    names = ["id", "question", "choices"]
    rows = questions.select(*names)
    for other in more:
        rows = rows.unionByName(other.select(*names))
    one = rows.where("id IS NOT NULL").groupBy("id").agg(
        F.max("question").alias("question"), F.max("choices.text").alias("options")
    )
    sequence = word_sequence(F.col("question"))
    options = word_sequence(F.array_join("options", " "))
    return one.select(
        "id",
        F.array_distinct(sequence).alias("q_words"),
        F.array_distinct(options).alias("o_words"),
        language(F.array_distinct(sequence), F.col("question")).alias("q_lang"),
        F.try_element_at(sequence, F.lit(-1)).alias("q_last"),
        F.transform("options", lambda x: F.try_element_at(word_sequence(x), F.lit(-1))).alias("o_last"),
    )


def is_copy(cover: float = 0.8, slack: float = 0.15) -> Column:
    """Whether ``words`` are the question's and nothing else."""
    none = F.array().cast("array<string>")
    q, o = F.col("q_words"), F.coalesce("o_words", none)
    around = F.array(*map(F.lit, AROUND.split()))
    extra = F.size(F.array_except(F.array_except(F.array_except(F.array_distinct("words"), q), o), around))
    allowed = F.greatest(F.lit(3.0), F.size(F.array_distinct("words")) * slack)
    core = F.filter("words", lambda w: F.array_contains(q, w) | ~(F.array_contains(o, w) | F.array_contains(around, w)))
    end = F.slice(core, F.greatest(F.size(core) - 7, F.lit(1)), F.lit(8))
    own = F.size(F.filter(end, lambda w: F.array_contains(q, w))) / F.greatest(F.size(end), F.lit(1))
    last = F.try_element_at("words", F.lit(-1))
    # What may stand around a question may also follow it.
    close = F.try_element_at(F.filter("words", lambda w: F.array_contains(q, w) | ~F.array_contains(around, w)), F.lit(-1))
    at_end = lambda w: F.coalesce((w == F.col("q_last")) | F.array_contains(F.coalesce("o_last", none), w), F.lit(False))
    ended = (F.col("ending") <= 0) | at_end(last) | at_end(close)
    # A question of a few words is copied only word by word.
    short = (F.size(q) > 0) & (F.size(q) < 4) & (F.size(F.array_except(q, "words")) == 0) & (extra == 0) & ended
    return F.coalesce(
        short
        | (
            (F.size(q) >= 4)
            & (F.size(F.array_intersect(q, "words")) >= F.size(q) * cover)
            & (extra <= allowed)
            & (own >= 0.6)
            & ended
        ),
        F.lit(False),
    )


def openings(rows: DataFrame, words: int = 8) -> DataFrame:
    """``rows`` with ``opening``, a hash of the first words, and ``grams``, their bigrams; null for a text without words."""
    first = F.slice("words", 1, words)
    grams = F.expr(
        f"array_sort(array_distinct(transform(sequence(1, greatest(least(size(words), {words}) - 1, 1)), "
        "i -> xxhash64(try_element_at(words, i), try_element_at(words, i + 1)))))"
    )
    some = F.size("words") > 0
    return rows.withColumn("opening", F.when(some, F.xxhash64(first))).withColumn("grams", F.when(some, grams))


def band_keys(bands: int = 3, width: int = 2) -> Column:
    """The MinHash band keys of ``grams``."""
    least = lambda s: F.array_min(F.transform("grams", lambda g: F.xxhash64(g, F.lit(s))))
    return F.array(*(F.xxhash64(F.lit(b), *(least(b * width + w) for w in range(width))) for b in range(bands)))


def stars(banded: DataFrame, verified: float = 0.5) -> DataFrame:
    """``band, leader, opening, prompts, k, c``: each opening that is like a leader of its band, with each such leader.

    ``banded`` is ``band, opening, prompts, k, c, grams``. In each band the candidate (``c`` above zero) with the most prompts is the first
    leader, and the best candidate that no leader is ``verified`` similar to is the next one, until none is left. Candidates
    come first in a band, so one reading is enough; a task holds the leaders of one band, not its members.
    """
    first = [F.col("band"), F.expr("c > 0").desc(), F.desc("prompts"), F.desc("opening")]
    ordered = banded.select("band", "opening", "prompts", "k", "c", "grams").repartition("band").sortWithinPartitions(*first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band, leaders, sets, places = None, [], [], {}
        for batch in batches:
            if not batch.num_rows:
                continue
            bands, openings, lead = batch["band"].to_numpy(), batch["opening"].to_numpy(), batch["c"].to_numpy(zero_copy_only=False) > 0
            grams = batch["grams"].to_pylist()
            found, leader = [], []
            for i, own in enumerate(bands.tolist()):
                if own != band:
                    band, leaders, sets, places = own, [], [], {}
                if not leaders and not lead[i]:
                    continue  # a band without a candidate
                words, like = frozenset(grams[i]), []
                # Who is alike has more than the rest of the words, so it has one of these, the rarest among the leaders.
                need = math.ceil(verified * len(words))
                rare = sorted(words, key=lambda g: len(places.get(g, ())))[: len(words) - need + 1]
                for j in {j for g in rare for j in places.get(g, ())}:
                    both = len(words & sets[j])
                    if both >= verified * (len(words) + len(sets[j]) - both):
                        like.append(j)
                if not like and lead[i]:
                    like = [len(leaders)]
                    leaders.append(openings[i])
                    sets.append(words)
                    for g in words:
                        places.setdefault(g, []).append(like[0])
                found += [i] * len(like)
                leader += [leaders[j] for j in like]
            if found:
                kept = batch.select(["band", "opening", "prompts", "k", "c"]).take(pa.array(found))
                yield kept.append_column("leader", pa.array(leader, pa.int64()))

    return ordered.mapInArrow(run, "band long, opening long, prompts long, k long, c int, leader long")


def around(banded: DataFrame, verified: float = 0.5, pairs: bool = False) -> DataFrame:
    """The cluster of each row with ``lead`` above zero: all openings of its band that are ``verified`` similar to it.

    ``banded`` is ``band, opening, prompts, k, lead, rest, grams``. The result is ``band, leader, opening, prompts, k``, or
    without ``pairs`` their sums ``band, leader, prompts, k, rest``. Leads come first in a band, so a task holds the leads of
    one band and meets all others batch by batch.
    """
    names = ["band", "opening", "prompts", "k", "lead", "rest", "grams"]
    ordered = banded.select(*names).repartition("band").sortWithinPartitions("band", F.desc("lead"))

    def keyed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bands, bigrams made different in each band, and how many a row has."""
        band = rows["band"].to_numpy()
        grams, sizes = lists(rows["grams"].combine_chunks())
        return band, mixed(grams ^ np.repeat(mixed(band.view(np.uint64)), sizes)), sizes

    def alike(rows: pa.Table, leads: pa.Table, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The places of rows and leads that are alike, from about ``most`` common bigrams at a time."""
        (band, grams, sizes), (own, keys, lengths) = keyed(rows), keyed(leads)
        order = np.argsort(keys)
        keys, owner = keys[order], np.repeat(np.arange(len(own)), lengths)[order]
        low = np.searchsorted(keys, grams)
        met = np.searchsorted(keys, grams, side="right") - low
        ends = np.cumsum(sizes)
        total = np.cumsum(np.add.reduceat(met, ends - sizes))
        for part in np.split(np.arange(len(band)), np.searchsorted(total, np.arange(most, total[-1], most))):
            if not len(part):
                continue
            at = slice(ends[part[0]] - sizes[part[0]], ends[part[-1]])
            row = np.repeat(np.repeat(part, sizes[part]), met[at])
            code = (row - part[0]) * len(own) + owner[np.repeat(low[at], met[at]) + within(met[at])]
            if len(part) * len(own) <= 8 * len(code):  # most rows meet most leads
                both = np.bincount(code)
                code = np.flatnonzero(both)
                both = both[code]
            else:
                code, both = np.unique(code, return_counts=True)
            x, y = code // len(own) + part[0], code % len(own)
            near = (band[x] == own[y]) & (both >= verified * (sizes[x] + lengths[y] - both))
            yield x[near], y[near]

    def clusters(rows: pa.Table, leads: pa.Table) -> Iterator[pa.RecordBatch]:
        for x, y in alike(rows, leads) if len(rows) and len(leads) else ():
            at = y if pairs else np.unique(y)
            made = {"band": leads["band"].to_numpy()[at], "leader": leads["opening"].to_numpy()[at]}
            for c in ("opening", "prompts", "k") if pairs else ("prompts", "k", "rest"):
                values = rows[c].to_numpy()[x]
                if not pairs:
                    sums = np.zeros(len(leads), np.int64)
                    np.add.at(sums, y, values)
                    values = sums[at]
                made[c] = values
            yield pa.RecordBatch.from_pydict(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None  # rows of a band whose leads may go on, and the leads of a band that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            band = rows["band"].to_numpy()
            goes_on = rows["lead"][-1].as_py() > 0
            end = int(np.searchsorted(band, band[-1])) if goes_on else len(rows)
            rows, held = rows.slice(0, end), rows.slice(end) if goes_on else None
            leads = rows.filter(pa.array(rows["lead"].to_numpy() > 0))
            leads = leads if known is None else pa.concat_tables([known, leads])
            yield from clusters(rows, leads)
            known = None if goes_on else leads.filter(pa.array(leads["band"].to_numpy() == band[-1]))
        if held is not None:
            yield from clusters(held, held)

    if pairs:
        return ordered.mapInArrow(run, "band long, leader long, opening long, prompts long, k long")
    sums = ordered.mapInArrow(run, "band long, leader long, prompts long, k long, rest long").groupBy("band", "leader")
    return sums.agg(*(F.sum(c).alias(c) for c in ("prompts", "k", "rest")))


def templates(rows: DataFrame, strength: float = 14.0, verified: float = 0.5, answers: float = 0.02) -> DataFrame:
    """``opening`` of each recurring template that comes without answers.

    ``rows`` are ``id, answered, candidate, opening, grams``, null openings left out. Each candidate leads a cluster in each
    of its bands: all openings of the band that are ``verified`` similar to it. A cluster is a template if its distinct prompts speak for a share of
    ``answers``, and not for that of the whole table, by a log likelihood ratio of ``strength``: one prompt asked
    many times counts once, and the fewer answers there are in the table the more prompts it takes. The candidates in
    any such cluster are returned.

    Not every cluster has to be counted. One that falls short with the openings that speak for it alone, or by its sums, is none. Of the others those of leaders unlike
    each other are counted first, and then all that still have a candidate that no template has.
    """
    known = rows.where("opening IS NOT NULL")
    per = cut(
        known.groupBy("opening", "id").agg(
            F.sum(F.col("answered").cast("int")).alias("k"), F.max(F.col("candidate").cast("int")).alias("c"), F.first("grams").alias("grams")
        )
    )
    share = known.agg(F.avg(F.col("answered").cast("int"))).first()[0] or 0.0
    share = min(max(share, 1e-3), 1 - 1e-3)
    gain, loss = math.log((1 - answers) / (1 - share)), math.log(answers / share) - math.log((1 - answers) / (1 - share))
    ratio = F.col("prompts") * gain + F.col("k") * min(loss, 0.0)
    each = per.groupBy("opening").agg(F.count(F.lit(1)).alias("prompts"), F.sum("k").alias("k"), F.max("c").alias("c"), F.first("grams").alias("grams"))
    each = cut(each.withColumn("bands", band_keys()))
    banded = each.select("opening", "prompts", "k", "c", "grams", F.explode("bands").alias("band"))
    names = ["band", "leader"]
    none, flag = F.lit(0).alias("rest"), F.lit(1).alias("lead")

    def counted(met: DataFrame) -> DataFrame:
        """The candidates in the clusters ``met`` that are templates."""
        # The prompts of all openings together are at least the distinct ones, so few clusters are counted exactly.
        likely = met.groupBy(*names).agg(F.sum("prompts").alias("prompts"), F.sum("k").alias("k")).where(ratio >= strength).select(*names)
        members = cut(met.join(likely, names).select(*names, "opening"))
        prompts = spread_join(per.select("opening", "id", "k"), members, "opening", "id").groupBy(*names, "id").agg(F.sum("k").alias("k"))
        sure = prompts.groupBy(*names).agg(F.count(F.lit(1)).alias("prompts"), F.sum("k").alias("k")).where(ratio >= strength)
        found = members.join(sure.select(*names), names).select("opening").distinct()
        return cut(found.join(each.where("c > 0").select("opening"), "opening", "left_semi"))

    def led(rows: DataFrame, leads: DataFrame) -> DataFrame:
        return rows.join(leads.select("band", F.col("leader").alias("opening"), flag), ["band", "opening"], "left").withColumn("lead", F.coalesce("lead", F.lit(0)))

    # All other openings lower the ratio.
    bound = around(banded.where((F.col("c") > 0) | (ratio > 0)).select("*", F.col("c").alias("lead"), none), verified)
    likely = cut(bound.where(ratio >= strength).select(*names))
    near = cut(led(banded.join(likely.select("band").distinct(), "band", "left_semi"), likely))
    # Those that fall short with all their openings end here, without a list of them.
    likely = cut(around(near.select("*", none), verified).where(ratio >= strength).select(*names))
    near = cut(led(near.drop("lead").join(likely.select("band").distinct(), "band", "left_semi"), likely))
    met = cut(stars(near.withColumn("c", F.col("lead")), verified))
    found = counted(met)
    rest = near.join(found.select("opening", F.lit(0).alias("rest")), "opening", "left").withColumn("rest", F.coalesce("rest", F.col("c")))
    others = likely.join(met.select(*names).distinct(), names, "left_anti")
    open_ones = around(led(rest.drop("lead"), others).where("lead > 0 OR rest > 0"), verified)
    others = cut(open_ones.where("rest > 0").select(*names))
    if others.isEmpty():
        return found
    last = near.drop("lead").join(others.select("band").distinct(), "band", "left_semi")
    return found.unionByName(counted(cut(around(led(last, others).select("*", none), verified, pairs=True)))).distinct()


def classify(responses: DataFrame, *questions: DataFrame) -> DataFrame:
    """``rec_id, model, run_id, gen_tokens, ending, error, defect, found_by``: one row for each response.

    ``defect`` is null for a response without one and never ``truncated``, which ``settled`` adds; ``ending`` are the log odds of a cut by the
    ending alone; ``found_by`` tells whether a refusal was found by its cluster or by a phrase. A response whose question is
    missing or null is compared with English and is never a copy. A null id is a missing question;
    an empty table gives an empty result; other columns are not read.
    """
    known = asked(*questions)
    rows = read(responses)
    words = F.coalesce(word_sequence(F.col("text")), F.array().cast("array<string>"))
    rows = rows.withColumn("words", F.when(F.col("error") | F.col("empty"), F.array().cast("array<string>")).otherwise(words))
    rows = rows.withColumn("lang", language(F.array_distinct("words"), F.col("text")))
    judged = rows.withColumn("declines", F.when(F.col("answered"), False).otherwise(F.coalesce(F.col("text").rlike(DECLINES), F.lit(False))))
    judged = judged.withColumn("candidate", ~F.col("answered") & (F.col("ending") <= 0) & ~F.col("error") & ~F.col("empty"))
    # One pass over the texts; beyond it the words are needed only where no answer is given.
    facts = ["rec_id", "id", "model", "run_id", "gen_tokens", "error", "empty", "answered", "ending", "lang", "declines", "candidate"]
    slim = cut(openings(judged).select(*facts, "opening", "grams", F.when(~F.col("answered"), F.col("words")).alias("words")))
    template = templates(slim.select("id", "answered", "candidate", "opening", "grams"))
    both = spread_join(slim, known, "id", "rec_id", "left")
    other = F.col("lang").isNotNull() & (F.col("lang") != F.coalesce("q_lang", F.lit("en")))
    # Words end here, so that the templates meet narrow rows.
    narrow = ["rec_id", "model", "run_id", "gen_tokens", "error", "empty", "ending", "declines"]
    judged = both.select(
        *narrow, F.when(F.col("candidate"), F.col("opening")).alias("opening"), (~F.col("answered") & is_copy()).alias("copied"), other.alias("other")
    )
    judged = spread_join(judged, template.withColumn("template", F.lit(True)), "opening", "rec_id", "left")
    by_cluster = F.coalesce(F.col("template"), F.lit(False))
    defect = (
        F.when(F.col("error"), None)
        .when(F.col("empty"), "empty")
        .when(F.col("copied"), "copy")
        .when(F.col("declines") | by_cluster, "refusal")
        .when(F.col("other"), "other_language")
    )
    by = F.when(defect == "refusal", F.when(by_cluster, "cluster").otherwise("phrase"))
    return judged.select("rec_id", "model", "run_id", "gen_tokens", "ending", "error", defect.alias("defect"), by.alias("found_by"))


def defect_report(settled_rows: DataFrame) -> DataFrame:
    """Records of each defect, of refusals also how they were found."""
    return settled_rows.where("defect IS NOT NULL").groupBy("defect", "found_by").agg(F.count(F.lit(1)).alias("records"))


# --- lengths -----------------------------------------------------------------


def _survival(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in np.atleast_1d(z)])


def _density(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def fit_censored(length: np.ndarray, seen: np.ndarray, cut: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Mean and deviation of log length by maximum likelihood (EM).

    ``seen`` and ``cut`` count the whole and the right-censored values at each length.
    """
    x = np.log(np.maximum(length, 1.0))
    n = seen.sum() + cut.sum()
    mu = float((x * (seen + cut)).sum() / n)
    sd = max(0.05, math.sqrt(float((((x - mu) ** 2) * (seen + cut)).sum() / n)))
    for _ in range(steps):
        z = (x - mu) / sd
        hazard = _density(z) / np.maximum(_survival(z), 1e-12)
        mean = mu + sd * hazard  # of a value known to exceed x
        square = mu * mu + sd * sd + sd * (x + mu) * hazard
        new = float((x * seen + mean * cut).sum() / n)
        var = float((x * x * seen + square * cut).sum() / n) - new * new
        mu, sd = new, max(0.05, math.sqrt(max(var, 0.0)))
    return mu, sd


def limits(histogram: DataFrame, share: float = 0.05, bound: float = 6.0) -> DataFrame:
    """``model, run_id, gen_tokens, odds``: log odds that a value of this length was censored.

    ``histogram`` is ``model, run_id, gen_tokens, seen, cut``: one row for each
    length of a source, so a group is bounded by the longest length. Candidate limits
    are the lengths that hold at least ``share`` of a source's cut values; elsewhere the
    source's rate of cuts stands alone. The odds are bounded, so that they weigh less than an ending that is sure.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = pdf[pdf.gen_tokens.notna()].sort_values("gen_tokens")
        cut, seen = known["cut"].to_numpy(float), known["seen"].to_numpy(float)
        rate = (pdf["cut"].sum() + 1) / (pdf["cut"].sum() + pdf["seen"].sum() + 2)
        base = math.log(rate / (1 - rate))
        out = pdf[["model", "run_id", "gen_tokens"]].copy()
        out["odds"] = min(bound, max(-bound, base))
        if len(known):
            length = known.gen_tokens.to_numpy(float)
            mu, sd = fit_censored(length, seen, cut)
            z = (np.log(np.maximum(length, 1.0)) - mu) / sd
            density = _density(z) / (sd * np.maximum(length, 1.0))
            at = (cut >= share * max(cut.sum(), 1)) & (cut >= 3)
            ratio = np.log(np.maximum(_survival(z), 1e-9)) - np.log(np.maximum(density, 1e-12))
            odds = np.clip(base + np.where(at, ratio, 0.0), -bound, bound)
            out.loc[known.index, "odds"] = odds
        return out

    return histogram.groupBy("model", "run_id").applyInPandas(run, "model string, run_id string, gen_tokens int, odds double")


def settled(classified: DataFrame) -> DataFrame:
    """``classified`` with ``posterior`` and the defect ``truncated`` where it is above one half.

    The posterior adds the log odds of the ending and those of the length. Runner errors and records with
    another defect have none. ``classified`` is read twice and should be written before.
    """
    open_rows = "NOT error AND defect IS NULL"
    histogram = classified.where(open_rows).groupBy("model", "run_id", "gen_tokens").agg(
        F.count_if(F.col("ending") <= 0).alias("seen"), F.count_if(F.col("ending") > 0).alias("cut")
    )
    # A null is a value of its own here; the hash stands for the three of them.
    place = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("model", "run_id", "gen_tokens")))
    odds = limits(histogram).select(place.alias("source"), "odds")
    met = spread_join(classified.withColumn("source", F.when(F.expr(open_rows), place)), odds, "source", "rec_id", "left")
    posterior = F.when(F.expr(open_rows), 1 / (1 + F.exp(-(F.col("ending") + F.coalesce("odds", F.lit(0.0))))))
    return met.withColumn("posterior", posterior).select(
        "rec_id", "model", "run_id", "error", F.when(F.col("posterior") > 0.5, "truncated").otherwise(F.col("defect")).alias("defect"), "found_by", "posterior"
    )


def truncated(settled_rows: DataFrame) -> DataFrame:
    """``rec_id`` of the truncated records."""
    return settled_rows.where("defect = 'truncated'").select("rec_id")


def truncation_report(settled_rows: DataFrame) -> DataFrame:
    """Responses and truncated responses of each model and run."""
    cases = F.count_if(F.coalesce(F.col("defect") == "truncated", F.lit(False)))
    counted = settled_rows.groupBy("model", "run_id").agg(F.count(F.lit(1)).alias("responses"), cases.alias("truncated"))
    return counted.withColumn("share", F.round(F.col("truncated") / F.col("responses"), 6))
