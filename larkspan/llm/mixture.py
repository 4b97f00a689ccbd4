"""A mixture of sources with target shares of the tokens: hash-random order, distributed prefix sums, exact cuts.

Within a source the texts are put in the order of a hash. The hash is uniform, so its leading bits cut every source into ranges of equal size without
sampling: a range sort whose bounds are known beforehand and the same on every retry. Token counts are summed per range, the few range sums are
added up per source, and inside each range a running sum completes the prefix sum. No range, and so no task, grows with the share of its source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.plans.lineage import store

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that goes with the ranks of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANGE_ROWS = 50_000  # texts of a range of hashes, about


@cache
def _encoding(vocabulary: bytes):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(rows: DataFrame, text_column: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """rows with the column text_column replaced by n_tokens, its size in tokens; null and empty texts have 0. Strings of special tokens are ordinary text.

    Only the driver reads the vocabulary file; the executors get its bytes, about a megabyte.
    """
    with open(tokenizer, "rb") as f:
        vocabulary = rows.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in rows.columns if c != text_column]
    schema = rows.select(*keep).schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary.value).encode_ordinary
        for batch in batches:
            sizes = [len(encode(x)) if x else 0 for x in batch.column(text_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    return rows.select(*keep, text_column).mapInArrow(run, schema)


def source_name(column: str) -> F.Column:
    """Trimmed of blanks and tabs, in lower case."""
    return F.lower(F.regexp_replace(F.col(column), r"^[ \t]+|[ \t]+$", ""))


def mixture(rows: DataFrame, id_column: str, text_column: str, source_column: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(picked, shares) of a mixture in which each source has its target share of the tokens.

    picked: doc_id, source, n_tokens, repeats: how often the text is used, from 1 to the source's max_repeats. A source is used whole as often as its
    budget holds it, then its texts in hash order up to the one whose end is nearest to the rest of the budget, so a source misses its budget by half a text at most.
    shares: a row for each target: source, target_share, max_repeats, available_tokens, budget_tokens, picked_tokens, n_documents, actual_share.
    total_tokens defaults to the most for which every source that has tokens can meet its share within max_repeats; a greater total leaves the sources
    short that cannot. A listed source without tokens has nothing to give; the others keep their budgets, and actual_share is of what was picked.
    Null texts and texts of no tokens are never picked, nor are sources that targets does not list, null sources, null ids, shares that are null or not
    above 0, and repeats below 1. Repeated rows of one id and source count once; targets has a row per source (of repeated ones the greatest counts).
    """
    wanted = targets.select(source_name("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("long").alias("max_repeats"))
    wanted = wanted.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    wanted = wanted.select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    named = rows.select(F.col(id_column).cast("long").alias("doc_id"), source_name(source_column).alias("source"), F.col(text_column).alias("text"))
    named = named.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL").join(wanted.select("source"), "source", "left_semi")
    counted = token_counts(named.select("doc_id", "source", "text"), "text", tokenizer).filter("n_tokens > 0")
    counted = counted.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"))
    counted = store(counted.withColumn("key", F.xxhash64(F.lit(seed), "doc_id")), "tokens")
    bits = 1 + (counted.count() // RANGE_ROWS).bit_length()
    counted = counted.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits).cast("int"))

    # At most 2 ** bits rows a listed source.
    sums = counted.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    order = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("before", F.sum("tokens").over(order) - F.col("tokens"))
    available = sums.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    able = wanted.join(available, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    if total_tokens is None:
        limit = able.filter("available_tokens > 0 AND target_share > 0 AND max_repeats > 0").agg(F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")).alias("most")).first()["most"]
        total_tokens = int(limit or 0)
    budget = F.least(F.floor(F.lit(float(total_tokens)) * F.greatest("target_share", F.lit(0.0))).cast("long"), F.col("available_tokens") * F.col("max_repeats"))
    able = able.withColumn("budget_tokens", budget)
    plan = able.filter("budget_tokens > 0").select("source", F.expr("budget_tokens DIV available_tokens").alias("whole"), (F.col("budget_tokens") % F.col("available_tokens")).alias("rest"))

    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(sums.join(plan, "source").select("source", "bucket", "before", "whole", "rest"), ["source", "bucket"])
    placed = placed.withColumn("end", F.col("before") + F.sum("n_tokens").over(within))
    near = F.col("end") - F.expr("n_tokens DIV 2") <= F.col("rest")
    picked = placed.select("doc_id", "source", "n_tokens", (F.col("whole") + near.cast("long")).alias("repeats")).filter("repeats > 0")

    got = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("picked_tokens"), F.count("*").alias("n_documents"))
    shares = able.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("picked_tokens", "n_documents")})
    everything = shares.agg(F.sum("picked_tokens").alias("everything"))
    shares = shares.crossJoin(F.broadcast(everything))  # one row
    shares = shares.select("source", "target_share", "max_repeats", "available_tokens", "budget_tokens", "picked_tokens", "n_documents", F.when(F.col("everything") > 0, F.col("picked_tokens") / F.col("everything")).otherwise(0.0).alias("actual_share"))
    return picked, shares
