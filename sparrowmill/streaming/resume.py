"""A streaming run: new question files are answered once, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runner import mock, prompt, records, todo, work_list
from ..sources.files import append_records, read_records


def answer_stream(spark: SparkSession, questions: DataFrame, models: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Answer the questions of a stream with the mock backend and append their records.

    Each batch leaves out ids that already have a record, so a batch that is run again after a failure adds nothing twice.
    The stream ends when all files present have been read.
    """

    def batch(df: DataFrame, _: int) -> None:
        work = todo(work_list(df.dropDuplicates(["id"]), models), read_records(spark, folder))
        ready = work.withColumn("prompt", prompt(F.col("question"), F.col("choices")))
        append_records(records(mock(ready), is_mock=True), folder)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
