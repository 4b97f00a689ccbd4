"""Streaming twins of the usage figures, and token state with a time to live."""

from __future__ import annotations

import base64
import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.operators.usage import by_tool
from larkspan.plans.lineage import exists, new_path


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there now, as a table in the shared folder: complete results replace it with each batch, others are added to it."""
    spark: SparkSession = stream.sparkSession
    out = new_path(spark, f"stream-{name}")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    start = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", new_path(spark, f"progress-{name}"))
    start.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], stream.schema)


def stream_by_tool(calls: DataFrame) -> DataFrame:
    """The statistics per tool of a stream; complete or update mode."""
    return by_tool(calls)


def stream_hourly(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls and failures by hour and tool; hours close once the watermark has passed."""
    w = calls.withWatermark("timestamp", late).groupBy(F.window("timestamp", "1 hour"), "tool")
    return w.agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failed")).select(F.col("window.start").alias("hour"), "tool", "calls", "failed")


def upsert_stream(changes: DataFrame, merge, where: str):  # noqa: ANN001, ANN201
    """Starts a stream whose batches are given to merge(batch, epoch), which replaces a table."""
    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", where).trigger(availableNow=True).start()


# tokens: payload topic|id|seconds, signed


def signature(key: bytes, payload: str) -> str:
    """HMAC-SHA256 in base 64, 22 characters."""
    return base64.b64encode(hmac.new(key, payload.encode(), hashlib.sha256).digest()).decode()[:22]


def sign(key: bytes, payload: str) -> Column:
    """signature of a column, inside the JVM: an HMAC is two nested hashes over the key, padded to a block and combined with two fixed bytes."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.col(payload).cast("binary")), 256))
    return F.substring(F.base64(F.unhex(F.sha2(F.concat(outer, first), 256))), 1, 22)


def validate_tokens(tokens: DataFrame, registry: DataFrame, key: bytes, as_of_seconds: int, ttl: int = 60) -> DataFrame:
    """tokens (token, expected_topic) with result: empty, format, signature, time, expired, topic, unknown or valid; registry is (token_id)."""
    p = F.split("token", "[|]")
    t = tokens.withColumn("p", p).withColumn("payload", F.array_join(F.slice("p", 1, 3), "|"))
    t = t.withColumn("own", sign(key, "payload")).withColumn("token_id", F.get("p", F.lit(1))).withColumn("at", F.get("p", F.lit(2)).try_cast("bigint"))
    t = t.join(registry.select("token_id", F.lit(True).alias("registered")).distinct(), "token_id", "left")
    result = (
        F.when(F.coalesce(F.trim("token"), F.lit("")) == "", "empty")
        .when(F.size("p") != 4, "format")
        .when(F.get("p", F.lit(3)) != F.col("own"), "signature")
        .when(F.col("at").isNull(), "time")
        .when(as_of_seconds - F.col("at") > ttl, "expired")
        .when(F.lower(F.get("p", F.lit(0))) != F.lower("expected_topic"), "topic")
        .when(F.col("registered").isNull(), "unknown")
        .otherwise("valid")
    )
    return t.select("token", "expected_topic", result.alias("result"))


def live_tokens(issued: DataFrame, as_of: str, ttl: str = "INTERVAL 1 MINUTE") -> DataFrame:
    """Tokens issued (token_id, topic, issued_at) that have not expired at as_of: the batch twin of keyed state with a time to live."""
    return issued.filter(F.col("issued_at") + F.expr(ttl) >= F.lit(as_of).cast("timestamp"))


class _Registry(StatefulProcessor):
    """Per token id: when it was issued, forgotten by the state store after the time to live."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.issued = handle.getValueState("issued", "topic string", self.ttl * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        for batch in rows:
            for topic, kind in zip(batch["topic"], batch["kind"], strict=True):
                if kind == "issue":
                    self.issued.update((topic,))
                else:
                    known = self.issued.exists() and (self.issued.get()[0] or "").lower() == (topic or "").lower()
                    yield pd.DataFrame({"token_id": [key[0]], "topic": [topic], "known": [known]})

    def close(self) -> None:
        pass


def stream_tokens(events: DataFrame, ttl_seconds: int = 60) -> DataFrame:
    """(token_id, topic, known) of every check in a stream of events (token_id, topic, kind: issue or check): known if the token was issued for the topic within the time to live.

    The issued tokens are keyed state that the store itself forgets; it must be the RocksDB state store (ROCKS), which alone can. As forgetting goes by the clock, the stream has a batch for
    each trigger whether there is data or not: start it with a processing-time trigger.
    """
    keyed = events.select("token_id", "topic", "kind").groupBy("token_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Registry(ttl_seconds), outputStructType="token_id string, topic string, known boolean", outputMode="Append", timeMode="ProcessingTime")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
