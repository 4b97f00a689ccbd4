"""Usage log: totals, statistics per tool, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = "timestamp timestamp, tool string, parameters map<string,string>, success boolean, resultSummary string, error string, durationMs bigint, inputChars int, outputChars int, inputTokens int, outputTokens int, tokensPerSecond double"


def since(calls: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Calls of the last hours before as_of."""
    return calls.filter(F.col("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def totals(calls: DataFrame) -> DataFrame:
    n, good = F.count("*"), F.count_if("success")
    rate = F.when(n > 0, F.bround(good * 100.0 / n, 1)).otherwise(0.0)
    s = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return calls.agg(n.alias("total_calls"), good.alias("successful"), F.count_if(~F.col("success")).alias("failed"), s("durationMs").alias("total_ms"), s("inputChars").alias("input_chars"), s("outputChars").alias("output_chars"), rate.alias("success_rate"))


def by_tool(calls: DataFrame, tool_filter: str | None = None) -> DataFrame:
    """Per tool: calls, success rate unrounded, mean duration cut to a whole number, token figures over calls that have them. The filter narrows this table only."""
    c = calls if not tool_filter else calls.filter(F.lower("tool").contains(tool_filter.lower()))
    has = F.col("outputTokens").isNotNull()
    tokens = lambda x: F.sum(F.when(has, F.coalesce(F.col(x), F.lit(0)))).cast("bigint")
    speed = F.bround(F.avg(F.when(has, F.coalesce("tokensPerSecond", F.lit(0.0)))), 1)
    return c.groupBy("tool").agg(
        F.count("*").alias("calls"),
        (F.count_if("success") * 100.0 / F.count("*")).alias("success_rate"),
        F.avg("durationMs").cast("bigint").alias("avg_ms"),
        F.sum("durationMs").cast("bigint").alias("total_ms"),
        tokens("inputTokens").alias("input_tokens"),
        tokens("outputTokens").alias("output_tokens"),
        speed.alias("avg_speed"),
    )


def token_figures(calls: DataFrame) -> DataFrame:
    """One row over the calls that have output tokens: their number, input and output tokens, and the mean speed."""
    has = calls.filter("outputTokens IS NOT NULL")
    s = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint")
    return has.agg(F.count("*").alias("calls"), s("inputTokens").alias("input_tokens"), s("outputTokens").alias("output_tokens"), F.bround(F.avg(F.coalesce("tokensPerSecond", F.lit(0.0))), 1).alias("avg_speed"))


def report(calls: DataFrame, tool_filter: str | None = None) -> str:
    """The report as Markdown: two small aggregates are collected, a row and a row for each tool."""
    t = totals(calls).first()
    lines = ["# Usage", "", f"Calls: {t['total_calls']:,}, successful: {t['successful']:,} ({t['success_rate']:.1f} %), time: {t['total_ms']:,} ms", "", "| tool | calls | success | mean ms |", "| --- | ---: | ---: | ---: |"]
    for r in by_tool(calls, tool_filter).orderBy(F.desc("calls"), "tool").collect():
        lines.append(f"| {r['tool']} | {r['calls']:,} | {r['success_rate']:.1f} % | {r['avg_ms']:,} |")
    return "\n".join(lines) + "\n"
