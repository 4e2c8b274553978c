"""Exact histogram of encoded lengths, and what every context limit keeps of the corpus.

Texts are encoded once; lengths are counted with map-side combine, so what is shuffled is
one row per task and distinct length. Suffix sums over the histogram answer for each
context limit how many documents and tokens fit whole, and how many remain when longer
documents are truncated there or left out.

The suffix window runs over one row per *distinct* length, a bound set by the longest
document and not by their number: window sums are taken inside ranges of lengths and the
totals of the ranges are added, so no task holds the whole histogram.

Defined results: a null text has length zero; repeated rows count each time; an empty
table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adlens.llm.common import column_chunks, written
from adlens.llm.tokens import encoder

RANGE = 4096  # lengths that one window task takes


def lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The encoded length (n_tokens) of every row."""
    def run(batches):
        enc = encoder(tokenizer)
        size = enc.dtype.itemsize
        for b in batches:
            out = [len(raw) // size for _, texts in column_chunks(b.column("text")) for raw in enc.encode(texts)]
            yield pa.record_batch([pa.array(out, pa.int64())], ["n_tokens"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, documents; written once."""
    return written(lengths(docs, tokenizer).groupBy("n_tokens").agg(F.count("*").alias("documents")), "lengths")


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: what fits, what is cut, and the quantile it stands for."""
    cell = F.floor(F.col("n_tokens") / RANGE)
    h = histogram.select("n_tokens", "documents", (F.col("n_tokens") * F.col("documents")).alias("tokens"),
                         cell.alias("cell"))
    after = Window.orderBy(F.col("cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = h.groupBy("cell").agg(F.sum("documents").alias("d"), F.sum("tokens").alias("t"))
    totals = cells.select("cell", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"),
                          F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
                          F.sum("d").over(Window.partitionBy()).alias("d_all"),
                          F.sum("t").over(Window.partitionBy()).alias("t_all"))
    longer = Window.partitionBy("cell").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    s = (h.join(totals, "cell")
         .withColumn("longer_documents", F.coalesce(F.sum("documents").over(longer), F.lit(0)) + F.col("d_after"))
         .withColumn("longer_tokens", F.coalesce(F.sum("tokens").over(longer), F.lit(0)) + F.col("t_after")))
    limit = F.col("n_tokens")
    return s.select(
        limit.alias("context_limit"), "documents",
        (F.col("d_all") - F.col("longer_documents")).alias("whole_documents"),
        (F.col("t_all") - F.col("longer_tokens")).alias("whole_tokens"),
        F.col("longer_documents").alias("truncated_documents"),
        (F.col("longer_tokens") - F.col("longer_documents") * limit).alias("lost_tokens"),
        (F.col("t_all") - F.col("longer_tokens") + F.col("longer_documents") * limit).alias("kept_tokens"),
        F.col("t_all").alias("total_tokens"),
        ((F.col("d_all") - F.col("longer_documents")) / F.col("d_all")).alias("quantile"))
