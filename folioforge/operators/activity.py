"""Jobs and usage records: repeated and late rows, latest states, sums and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import latest_rows

ORDER = ("queued", "running", "failed", "succeeded")
SUMS = ("word_count", "chunk_count", "translated_block_count", "estimated_input_tokens", "estimated_output_tokens",
        "estimated_prompt_overhead_tokens", "estimated_total_tokens")


def stage(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, ORDER)), status), F.lit(0))


def current_jobs(jobs: DataFrame) -> DataFrame:
    """The latest state of every job: the last update, of equal ones the furthest state."""
    return latest_rows(
        jobs, ["job_id"], F.desc_nulls_last("updated_at"), F.desc(stage(F.col("status"))),
        F.desc_nulls_last("progress"), F.asc_nulls_last("message"),
    )


def single_usage(usage: DataFrame) -> DataFrame:
    """One record a usage id: the first that was loaded."""
    return latest_rows(usage, ["usage_id"], F.asc_nulls_last("loaded_at"))


def once_a_job(usage: DataFrame) -> DataFrame:
    """One record a job: the first created, so recording twice changes nothing."""
    return latest_rows(single_usage(usage), ["job_id"], F.asc_nulls_last("created_at"), F.asc("usage_id"))


def usage_summary(usage: DataFrame, *keys: str) -> DataFrame:
    """Records and sums by key; nulls count as zero. Partial sums precede the shuffle, so a hot key
    sends a row a partition."""
    cost = F.coalesce("estimated_cost_usd", F.lit(0)).cast("decimal(12,6)")
    return usage.groupBy(*keys).agg(
        F.count("*").alias("record_count"),
        *[F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c) for c in SUMS],
        F.sum(cost).cast("double").alias("estimated_cost_usd"),
    )


def running_totals(usage: DataFrame, key: str, value: str) -> DataFrame:
    """Daily sums of a value by key with the sum up to and including the day.

    The window runs over days, not over records: a hot key has no more rows than days.
    """
    days = usage.groupBy(key, F.to_date("created_at").alias("day")).agg(
        F.sum(F.coalesce(value, F.lit(0))).cast("bigint").alias("day_sum")
    )
    window = Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumn("sum_so_far", F.sum("day_sum").over(window))


def late(usage: DataFrame, days: int) -> DataFrame:
    """Records loaded more than so many days after they were created."""
    delay = F.unix_micros("loaded_at") - F.unix_micros("created_at")
    return usage.where(delay > days * 86_400_000_000)


def appended(ledger: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key the ledger doesn't have yet, one a key: appending twice adds nothing."""
    return new.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")


def page(rows: DataFrame, order: list[Column], offset: int, limit: int, most: int = 100) -> DataFrame:
    """A page of an ordered table; the limit is held between 1 and ``most``."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))


def _options(payload: Column) -> Column:
    """A payload's values by name, in an order that can be compared; null for what is no object."""
    return F.array_sort(F.map_entries(F.from_json(payload, "map<string,string>")))


def replayed(jobs: DataFrame, asked: DataFrame, key: Column) -> DataFrame:
    """``asked``(document_id, job_type, key, payload_json) with the job_id and ``answer`` that each request gets.

    The last job of the document and type under the same key answers: ``replay`` if its payload is the same,
    else ``conflict``. A blank key, and one that no job has, gives ``new``. ``key`` is an expression over jobs.
    """
    keyed = jobs.withColumn("__key", F.nullif(F.btrim(key), F.lit(""))).where("__key is not null")
    last = F.max_by(F.struct("job_id", "payload_json"), F.struct("created_at", "job_id")).alias("j")
    known = keyed.groupBy("document_id", "job_type", "__key").agg(last)
    rows = asked.withColumn("__key", F.nullif(F.btrim("key"), F.lit(""))).join(known, ["document_id", "job_type", "__key"], "left")
    same = _options(F.col("j.payload_json")).eqNullSafe(_options(F.col("payload_json")))
    answer = F.when(F.col("j.job_id").isNull(), "new").when(same, "replay").otherwise("conflict")
    return rows.withColumns({"job_id": F.col("j.job_id"), "answer": answer}).drop("__key", "j")


#: Jobs of these types don't outlive the process that runs them.
TRANSLATING = ("translate_next", "retranslate_last", "translate_rest")


def interrupted(jobs: DataFrame, types: tuple[str, ...] = TRANSLATING) -> DataFrame:
    """The jobs after a restart: those that waited or ran have failed, with a message. Others stay as they are."""
    hit = F.coalesce(F.col("status").isin("queued", "running") & F.col("job_type").isin(*types), F.lit(False))
    changed = {
        "status": F.when(hit, "failed").otherwise(F.col("status")),
        "progress": F.when(hit, 100).otherwise(F.col("progress")),
        "message": F.when(hit, "Interrupted").otherwise(F.col("message")),
        "error_text": F.when(hit, "The job was interrupted by a restart; please try again.").otherwise(F.col("error_text")),
    }
    return jobs.withColumn("interrupted", hit).withColumns(changed)


def latest_exports(records: DataFrame) -> DataFrame:
    """The last of each document's export records(document_id, export_id, exported_at)."""
    names = [c for c in records.columns if c != "document_id"]
    last = F.max_by(F.struct(*names), F.struct("exported_at", "export_id")).alias("e")
    return records.groupBy("document_id").agg(last).select("document_id", "e.*")


def owned(rows: DataFrame, owner: str, provider: str | None = None) -> DataFrame:
    """The rows of an owner; with a provider only those that came through it. A null owner owns nothing."""
    mine = F.col("owner_user_id") == owner
    return rows.where(mine if provider is None else mine & (F.col("owner_auth_provider") == provider))


def authorized(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows``(document_id, owner_user_id, ...) with ``allowed``: whether that user owns the document in
    ``owners``(document_id, owner_user_id). Documents that don't exist are nobody's."""
    known = owners.select("document_id", F.col("owner_user_id").alias("__owner"))
    same = F.coalesce(F.col("owner_user_id") == F.col("__owner"), F.lit(False))
    return rows.join(known, "document_id", "left").withColumn("allowed", same).drop("__owner")


def changed(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Current jobs with changes(job_id, changed_at, and any of their columns) applied: of a job's changes the last
    counts, its nulls change nothing. Changes of jobs that don't exist are left out."""
    names = [c for c in changes.columns if c not in ("job_id", "changed_at")]
    last = F.max_by(F.struct(*names, "changed_at"), F.struct("changed_at", *names)).alias("__change")
    rows = jobs.join(changes.groupBy("job_id").agg(last), "job_id", "left")
    new = {c: F.coalesce(F.col(f"__change.{c}"), F.col(c)) for c in names}
    at = F.greatest("updated_at", "__change.changed_at")
    return rows.withColumns(new | {"updated_at": at}).drop("__change")
