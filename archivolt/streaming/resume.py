"""Answers as a stream: questions that arrive as files, each answered once, also over restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: State is kept on disk, so that ids of all questions so far need no memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def answer_new(spark: SparkSession, questions: str, schema: str, out: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame], done: DataFrame | None = None, files: int = 1000) -> dict:
    """Reads the question files that have not been read, and answers each id once; `done`(id) were answered before.

    Which ids have been seen is state of the stream, keyed by id, so no output is read again.  Each batch writes the folder
    batch=<number> of `out` as a whole: one that was cut off is run again with the same number, the same questions and the
    same state, and replaces what it had left.  Null ids are no questions.  Returns how many batches and questions came."""
    seen = {"batches": 0, "questions": 0}

    def one(batch: DataFrame, number: int) -> None:
        fresh = batch if done is None else batch.join(done.select("id"), "id", "left_anti")
        answer(fresh).write.mode("overwrite").json(f"{out}/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(questions).filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    run = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    for progress in run.recentProgress:
        seen["batches"] += 1
        seen["questions"] += progress["numInputRows"]
    return seen


def answers(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """All answers so far, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch int").json(out)
