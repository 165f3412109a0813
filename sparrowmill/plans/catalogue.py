"""The queries of the core; their SQL statements are in ``statements``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.extract import extract
from ..operators import cluster, metrics, profile, questions as Q, runner, sampling, similarity as S, splits
from ..session import materialised
from .statements import STATEMENTS

TRAIN, TEST = splits.TRAIN, splits.TEST


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base(spark: SparkSession, d: str) -> DataFrame:
    return Q.canonical(table(spark, d, "questions"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "responses").withColumn("split", X.split_name(F.col("split")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    both = Q.union_all([table(spark, d, "questions"), table(spark, d, "anchor_questions")])
    return Q.canonical(both)


def mcq_canonical(spark, d):
    return base(spark, d).select(
        "id",
        "dataset",
        "split",
        "n_choices",
        F.array_join("choices.label", "|").alias("labels"),
        F.array_join("choices.text", "|").alias("texts"),
        F.col("answerKey").alias("answer_key"),
        F.coalesce("subject", F.lit("nan")).alias("subject"),
    )


def question_integrity(spark, d):
    return Q.validate(table(spark, d, "questions"))


def stem_conversion(spark, d):
    raw = base(spark, d).where("dataset = 'openbookqa' AND split IS NOT NULL").withColumn("question_stem", F.col("question"))
    made = Q.from_stems(raw, "obqa", "id")
    return made.select("id", "question", "split", F.col("answerKey").alias("answer_key"))


FLAGS = ("categorical", "sufficient", "necessry", "disjunctive", "conjunctive")


def _passages(spark, d):
    raw = base(spark, d).where("dataset = 'logiqa2' AND split IS NOT NULL")
    # The passage stands in a column of its own or before the first blank line.
    at = F.instr("question", "\n\n")
    s = F.lower(F.coalesce("subject", F.lit("")))
    return raw.select(
        "split",
        F.col("id").alias("key"),
        F.coalesce("answerKey", F.lit("")).alias("_a"),
        F.coalesce("context", F.when(at > 0, F.left("question", at - 1)), F.lit("")).alias("text"),
        F.when(at > 0, F.substring("question", at + 2, F.length("question"))).otherwise(F.col("question")).alias("question"),
        F.col("choices.text").alias("options"),
        F.nullif(F.instr(F.lit("ABCD"), F.coalesce("answerKey", F.lit("?"))), F.lit(0)).alias("_i"),
        *(s.contains(f).alias(f) for f in FLAGS),
    ).withColumn("answer", F.col("_i") - 1)


def passage_conversion(spark, d):
    made = Q.from_passages(_passages(spark, d), "logiqa2", "key", flags={f: f for f in FLAGS})
    return made.select("id", "split", "question", "context", F.col("answerKey").alias("answer_key"), "subject")


def logical_type_labels(spark, d):
    rows = _passages(spark, d).select(Q.type_label({f: F.col(f) for f in FLAGS}, {f: f for f in FLAGS}).alias("label"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def file_splits(spark, d):
    names = base(spark, d).select(F.concat("dataset", F.lit("_"), F.initcap(F.coalesce("split", F.lit("x"))), F.lit(".parquet")).alias("file"))
    return names.select("file", X.infer_split(F.col("file")).alias("split"), X.infer_split(F.col("file"), True).alias("strict_split")).groupBy(
        "file", "split", "strict_split"
    ).agg(F.count(F.lit(1)).alias("n"))


def split_overview(spark, d):
    return profile.overview(base(spark, d))


def answer_key_distribution(spark, d):
    return profile.shares(base(spark, d).select("dataset", F.col("answerKey").alias("answer_key")), "dataset", "answer_key")


def text_stats(spark, d):
    return profile.text_stats(base(spark, d))


def option_length_stats(spark, d):
    return profile.option_stats(base(spark, d))


def vocab_jaccard(spark, d):
    return profile.vocabulary_overlap(base(spark, d))


def leakage_profile(spark, d):
    return profile.leakage(base(spark, d))


def dedup_exact(spark, d):
    return splits.dedup(base(spark, d)).select("id", "dataset")


def decontaminate(spark, d):
    b = base(spark, d)
    return splits.decontaminate(b.where("split IN ('train', 'validation')"), b.where("split = 'test'")).select("id", "dataset")


def uniform_sample(spark, d):
    return sampling.uniform(base(spark, d), ["dataset"], 200).select("id", "dataset")


def half_split(spark, d):
    return sampling.halves(base(spark, d).where("split = 'test'"), ["dataset"]).select("id", "dataset", "half")


def stratified_train_sample(spark, d):
    return sampling.stratified(splits.pools(base(spark, d)).where("pool = 'train'"), TRAIN).select("id", "dataset")


def group_split(spark, d):
    return splits.pools(base(spark, d)).select("id", "dataset", "pool")


def antileak_test_candidates(spark, d):
    return splits.build(base(spark, d))[2].select("id", "dataset")


def frozen_splits(spark, d):
    tr, te, _ = splits.build(base(spark, d))
    return tr.select("id", "dataset", F.lit("train").alias("piece")).unionByName(te.select("id", "dataset", F.lit("test").alias("piece")))


def split_manifest(spark, d):
    return splits.manifest(base(spark, d))


def split_disjointness(spark, d):
    tr, te, _ = splits.build(base(spark, d))
    return splits.disjointness(tr, te)


def prompt_render(spark, d):
    text = runner.prompt(F.col("question"), F.col("choices"))
    return base(spark, d).select("id", text.alias("prompt"), runner.template_id().alias("prompt_sha"))


def _mock(spark, d):
    work = runner.work_list(base(spark, d).where("split = 'test'"), table(spark, d, "model_registry"))
    return runner.mock(work.withColumn("prompt", runner.prompt(F.col("question"), F.col("choices"))))


def mock_responses(spark, d):
    return _mock(spark, d).select("model", "id", "raw_response", F.bround("wall_time_s", 3).alias("wall_time_s"), "gen_tokens")


def mock_run_records(spark, d):
    made = runner.records(_mock(spark, d), is_mock=True)
    return made.select("model", "id", "gold", "pred", "valid", "extraction_method", "strict_format", "correct", "mock")


def extract_answers(spark, d):
    asked = _asked(spark, d).select("id", "choices")
    rows = table(spark, d, "responses").select("rec_id", "id", "raw_response").join(asked, "id", "left")
    found = rows.select("rec_id", extract(F.col("raw_response"), F.col("choices.label"), F.col("choices.text")).alias("x"))
    return found.select("rec_id", F.col("x.pred").alias("pred"), F.col("x.method").alias("method"))


def normal_values(spark, d):
    texts = base(spark, d).select(F.explode("choices.text").alias("value")).where("value IS NOT NULL").distinct()
    return texts.select("value", X.norm_value(F.col("value")).alias("norm"))


def string_functions(spark, d):
    q = F.col("question")
    return base(spark, d).select(
        "id",
        X.slug(F.concat("dataset", F.lit(" "), q)).alias("slug"),
        X.prefix(q).alias("prefix"),
        F.right(q, F.lit(200)).alias("tail"),
        X.norm_text(q).alias("norm"),
        X.word_count(q).alias("words"),
        F.size(X.tokens(q)).alias("tokens"),
        F.bround(X.numeric_density(X.tokens(q)), 6).alias("density"),
        X.short_sha(q).alias("sha"),
        X.hash_mod(q, 97).alias("mod97"),
    )


def run_metrics(spark, d):
    return metrics.run_metrics(_records(spark, d))


def run_metrics_full(spark, d):
    return metrics.run_metrics_full(_records(spark, d))


def accuracy_by_length_quartile(spark, d):
    return metrics.accuracy_by_length(_records(spark, d))


def prediction_bias(spark, d):
    return metrics.prediction_shares(_records(spark, d))


def extraction_method_share(spark, d):
    return metrics.method_shares(_records(spark, d))


def latency_box(spark, d):
    return metrics.box_stats(_records(spark, d))


def reasoning_histogram(spark, d):
    return metrics.histogram(_records(spark, d))


def accuracy_interval(spark, d):
    return metrics.accuracy_interval(_records(spark, d))


def any_mock(spark, d):
    return metrics.any_mock(_records(spark, d))


def resume_todo(spark, d):
    work = runner.work_list(base(spark, d), table(spark, d, "model_registry"))
    return runner.todo(work, _records(spark, d)).select("model", "dataset", "split", "id")


def plan_cost(spark, d):
    return runner.plan_cost(base(spark, d), table(spark, d, "model_registry"))


def tfidf_weights(spark, d):
    w = S.tfidf(base(spark, d), "id", F.col("question"), [])
    return w.select("id", "term", F.bround("w", 6).alias("w"))


def _frozen(spark, d):
    tr, te, _ = splits.build(base(spark, d))
    return materialised(tr.select("dataset", "id", "question")), materialised(te.select("dataset", "id", "question"))


def retrieval_top1(spark, d):
    return S.top_similarities(*_frozen(spark, d)).select("dataset", "id", "top1")


def retrieval_top5(spark, d):
    return S.top_similarities(*_frozen(spark, d)).select("dataset", "id", "top_k_mean")


def retrieval_report(spark, d):
    return S.retrieval_report(S.top_similarities(*_frozen(spark, d)))


def tfidf_cohesion(spark, d):
    drawn = sampling.uniform(base(spark, d), ["dataset"], 300)
    w = S.tfidf(drawn, "id", F.col("question"), []).join(drawn.select("id", "dataset"), "id")
    return S.cohesion(w, "dataset", "id", "term", "w")


def embedding_cosine_top1(spark, d):
    rows = table(spark, d, "embeddings")
    return S.nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding")


def embedding_cohesion(spark, d):
    return S.dense_cohesion(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def impact_score(spark, d):
    b = materialised(base(spark, d))
    reasoning = table(spark, d, "dataset_registry").select("dataset", "dominant_reasoning", "error_type")
    density = profile.text_stats(b).select("dataset", "numeric_density")
    drawn = sampling.uniform(b, ["dataset"], 300)
    w = S.tfidf(drawn, "id", F.col("question"), []).join(drawn.select("id", "dataset"), "id")
    inner = S.cohesion(w, "dataset", "id", "term", "w").where("a = b").select(F.col("a").alias("dataset"), "cohesion")
    tr, te, _ = splits.build(b)
    tops = S.retrieval_report(S.top_similarities(tr, te)).select("dataset", "mean_top1")
    return S.impact(reasoning, density, inner, tops)


def svd_cohesion(spark, d):
    drawn = materialised(sampling.uniform(base(spark, d), ["dataset"], 300).select("id", "dataset", "question"))
    latent = cluster.latent(drawn, "id", F.col("question")).join(drawn.select("id", "dataset"), "id")
    return S.dense_cohesion(latent, "dataset", "id", "vector")


def cluster_quota_sample(spark, d):
    drawn = materialised(base(spark, d).where("dataset IN ('aqua', 'gsm8k')").select("id", "dataset", "question"))
    latent = cluster.latent(drawn, "id", F.col("question"))
    clusters = cluster.kmeans(latent, "id", "vector").withColumn("cluster", F.col("cluster").cast("string"))
    named = drawn.join(clusters, "id", "left")
    return sampling.stratified(named, TEST, stratum="cluster", floor=0).select("id", "dataset", "cluster")


QUERIES = [
    mcq_canonical, question_integrity, stem_conversion, passage_conversion, logical_type_labels, file_splits, split_overview,
    answer_key_distribution, text_stats, option_length_stats, vocab_jaccard, leakage_profile, dedup_exact, decontaminate,
    uniform_sample, half_split, stratified_train_sample, group_split, antileak_test_candidates, frozen_splits, split_manifest,
    split_disjointness, prompt_render, mock_responses, mock_run_records, extract_answers, normal_values, string_functions,
    run_metrics, run_metrics_full, accuracy_by_length_quartile, prediction_bias, extraction_method_share, latency_box,
    reasoning_histogram, accuracy_interval, any_mock, resume_todo, plan_cost, tfidf_weights, retrieval_top1, retrieval_top5,
    retrieval_report, tfidf_cohesion, embedding_cosine_top1, embedding_cohesion, impact_score, svd_cohesion, cluster_quota_sample,
]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict:
    return dict(STATEMENTS)
