"""Token estimates from word counts; halves go to the even number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENS_PER_WORD = 1.35
PROMPT_TOKENS = 350


def tokens(words: Column) -> Column:
    """At least one token for any text."""
    return F.greatest(F.lit(1), F.bround(words * F.lit(TOKENS_PER_WORD), 0).cast("bigint"))


def estimate(words: Column, chunks: Column) -> dict[str, Column]:
    """Input, output, overhead and total tokens; no words give no tokens beyond the overhead."""
    some = words > 0
    overhead = (chunks * PROMPT_TOKENS).cast("bigint")
    output = F.when(some, tokens(words)).otherwise(F.lit(0).cast("bigint"))
    asked = F.when(some, tokens(words) + overhead).otherwise(F.lit(0).cast("bigint"))
    return {
        "input_tokens": asked,
        "output_tokens": output,
        "prompt_tokens": overhead,
        "total_tokens": asked + output,
    }


def estimate_sql(words: str, chunks: str) -> str:
    tokens = f"greatest(1, round_even({words} * {TOKENS_PER_WORD}::DOUBLE, 0)::BIGINT)"
    overhead = f"({chunks} * {PROMPT_TOKENS})::BIGINT"
    asked = f"CASE WHEN {words} > 0 THEN {tokens} + {overhead} ELSE 0 END"
    output = f"CASE WHEN {words} > 0 THEN {tokens} ELSE 0 END"
    return (
        f"{asked} AS input_tokens, {output} AS output_tokens, {overhead} AS prompt_tokens, "
        f"{asked} + {output} AS total_tokens"
    )
