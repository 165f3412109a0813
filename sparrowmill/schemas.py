"""Schemas of the tables this library reads and writes."""

from pyspark.sql import types as T

CHOICES = T.StructType().add("label", T.ArrayType(T.StringType())).add("text", T.ArrayType(T.StringType()))

#: The four columns every question table has, and the optional ones.
QUESTION = (
    T.StructType()
    .add("id", T.StringType())
    .add("question", T.StringType())
    .add("choices", CHOICES)
    .add("answerKey", T.StringType())
    .add("context", T.StringType())
    .add("subject", T.StringType())
)
REQUIRED = ("id", "question", "choices", "answerKey")

SPLIT = (
    T.StructType()
    .add("id", T.StringType())
    .add("dataset", T.StringType())
    .add("question", T.StringType())
    .add("choices", CHOICES)
    .add("answerKey", T.StringType())
    .add("subject", T.StringType())
)

# The names of an inference record. The three durations come only from some backends.
RECORD = (
    T.StructType()
    .add("id", T.StringType())
    .add("dataset", T.StringType())
    .add("split", T.StringType())
    .add("model", T.StringType())
    .add("hf_model", T.StringType())
    .add("mock", T.BooleanType())
    .add("prompt_sha", T.StringType())
    .add("seed", T.IntegerType())
    .add("gold", T.StringType())
    .add("pred", T.StringType())
    .add("valid", T.BooleanType())
    .add("extraction_method", T.StringType())
    .add("strict_format", T.BooleanType())
    .add("correct", T.BooleanType())
    .add("ts", T.StringType())
    .add("raw_response", T.StringType())
    .add("wall_time_s", T.DoubleType())
    .add("prompt_tokens", T.IntegerType())
    .add("gen_tokens", T.IntegerType())
    .add("gen_duration_s", T.DoubleType())
    .add("total_duration_s", T.DoubleType())
    .add("load_duration_s", T.DoubleType())
)
