"""From raw documents to packed training sequences: language ID, quality, near-duplicates, packing.

Each stage takes what the one before has kept, written as Parquet in the shared folder and read again, so that a lost
executor costs no more than the stage that runs.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm.frames import read, remove, shared_dir
from rillstone.llm.language import keep_languages
from rillstone.llm.packing import pack
from rillstone.llm.quality import keep_quality
from rillstone.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", lambda spark, docs, sf_dir: keep_languages(docs)),
    ("quality", lambda spark, docs, sf_dir: keep_quality(docs, read(spark, sf_dir, "labels"))),
    ("near_duplicates", lambda spark, docs, sf_dir: drop_near_duplicates(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs)),
]

#: Viterbi paths, kernel scores and best-fit plans aren't for SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, length, bin_id, start) of the documents that all filters keep.

    What a stage has written is deleted when the next one has written its own; the last one's rows stay, to be read.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        now = f"{base}/{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            remove(spark, before)
        before = now
    return docs
