"""Predicates over labels and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, strip

# Parts of error messages, lower case. What is permanent isn't tried again, whatever else a
# message says. A service that answers requests and a batch run have a list each.
SERVICE_PERMANENT = (
    "401", "403", "404", "api key not valid", "authentication", "bad request", "invalid api key", "invalid model",
    "model not found", "permission denied", "quota", "unauthorized",
)
SERVICE_PASSING = (
    "429", "500", "502", "503", "504", "api connection", "connection reset", "dns", "getaddrinfo",
    "internal server error", "rate limit", "resource exhausted", "service unavailable", "timeout", "timed out", "try again",
)
BATCH_PERMANENT = (
    "401", "403", "404", "api key not valid", "authentication", "bad request", "invalid api key", "invalid model",
    "invalid request", "model not found", "not found", "permission denied", "quota", "unauthorized",
)
BATCH_PASSING = (
    "429", "502", "503", "504", "500", "api connection", "apiconnectionerror", "connection reset", "connecterror", "dns",
    "getaddrinfo", "internal server error", "internalservererror", "internal error", "rate limit", "resource exhausted",
    "server disconnected", "service unavailable", "temporarily", "timeout", "timed out", "timeouterror", "try again",
)
SERVICE, BATCH = (SERVICE_PERMANENT, SERVICE_PASSING), (BATCH_PERMANENT, BATCH_PASSING)


def retryable(message: Column, rules: tuple = SERVICE) -> Column:
    """Whether an error passes by itself; null doesn't."""
    permanent, passing = rules
    low = F.lower(F.coalesce(message, F.lit("")))

    def some(parts: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, parts)), lambda p: low.contains(p))

    return some(passing) & ~some(permanent)


def retryable_sql(message: str, rules: tuple = SERVICE) -> str:
    def some(parts: tuple[str, ...]) -> str:
        return "(" + " OR ".join(f"contains(lower(coalesce({message}, '')), '{p}')" for p in parts) + ")"

    return f"({some(rules[1])} AND NOT {some(rules[0])})"


def passes(error: BaseException, rules: tuple = BATCH) -> bool:
    """The same for an exception, by its type and message."""
    permanent, passing = rules
    low = f"{type(error).__name__}: {error}".lower()
    return any(p in low for p in passing) and not any(p in low for p in permanent)


def short_message(message: Column, most: int = 240) -> Column:
    line = strip(F.regexp_replace(message, r"\s+", " "))
    return F.when(F.char_length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most - 3)), F.lit("...")))


def same_language(a: Column, b: Column) -> Column:
    """Whether two names of languages are one, whatever their case."""
    return casefold(strip(a)) == casefold(strip(b))


def named_or(value: Column, default: str) -> Column:
    """A name, or the default for null and blank."""
    return F.coalesce(F.nullif(strip(value), F.lit("")), F.lit(default))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """JSON under a schema; null, blank and broken texts give the default."""
    return F.coalesce(F.from_json(F.nullif(strip(text), F.lit("")), schema), default)
