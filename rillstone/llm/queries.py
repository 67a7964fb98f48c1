"""The queries of the operators in this subpackage, each over its whole table, and SQL for those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, graphs, language, linkgraph, media, ngrams, packing, perspectives, quality, simhash
from .frames import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_duplicates": lambda spark, d: simhash.near_duplicates(read(spark, d, "documents")),
    "op2_media_tiles": lambda spark, d: media.media_tiles(media.pictures(read(spark, d, "documents"))),
    "op3_lm_scores": lambda spark, d: ngrams.lm_scores(read(spark, d, "documents")),
    "op4_url_trust": lambda spark, d: linkgraph.url_trust(read(spark, d, "pages")),
    "op5_best_fit_packing": lambda spark, d: packing.pack(read(spark, d, "documents")),
    "op6_nearest_neighbours": lambda spark, d: graphs.nearest_neighbours(read(spark, d, "embeddings"), graphs.asked_every(read(spark, d, "embeddings"))),
    "op7_perspective_rotation": lambda spark, d: perspectives.rotate(read(spark, d, "conversations")),
    "op8_byte_bpe": lambda spark, d: bpe.bpe_encode(read(spark, d, "documents")),
    "op9_language_spans": lambda spark, d: language.language_spans(read(spark, d, "documents")),
    "op10_quality_scores": lambda spark, d: quality.quality_scores(read(spark, d, "documents"), read(spark, d, "labels")),
}

SQL: dict[str, str] = {"op4_url_trust": linkgraph.SQL, "op7_perspective_rotation": perspectives.SQL}
