"""Problem 6: items of varying length into containers of a fixed capacity.

Optimal length buckets. The histogram of lengths (at most one entry a token of capacity) decides
everything: dynamic programming over it chooses the bucket boundaries that minimise padding, the
slopes of a lower envelope making a step linear. An item counts as long as its bucket's boundary.

Batches of one bucket alone leave up to half a container unused (a bucket of 300 tokens in 512), so
batches under the token budget also draw from several buckets: the plan goes through the buckets from
long to short and tops up the fullest open containers first, for all containers of a kind at once. It
works on counts only and has a size that depends on the number of buckets, not on the data.

Items find their place by number. Numbers within a bucket are dealt out in ``slots`` parts, by a hash
of the item, with the parts' offsets from an aggregate; so a bucket with a third of all items isn't
numbered in one task.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import spread

TOKENIZER_FILE = "byte_bpe_multi_50k.tiktoken"
TOKENIZER_FOLDER = "/opt/tokenizers"
BUCKETS = 128
ITEMS_A_SLOT = 50_000

# Fixed value: how the vocabulary's byte-level BPE cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(folder: str = TOKENIZER_FOLDER, name: str = TOKENIZER_FILE) -> str:
    """Where the vocabulary lies: in the folder, or with the package that brings it."""
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        try:
            import public_tokenizers

            path = public_tokenizers.path(name)
        except ImportError:
            pass
    return path


@lru_cache(2)
def encoding(path: str):
    """The byte-level BPE of a vocabulary file, loaded once a process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, tokens) of each row; null and empty texts have none.

    The vocabulary is read where it lies on the driver and sent to the workers as a file, so they need none.
    """
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(os.path.basename(path))
        encode = encoding(sent if os.path.exists(sent) else path).encode_ordinary
        for batch in batches:
            n = np.fromiter((len(encode(t)) if t else 0 for t in batch[text]), np.int64, len(batch))
            yield pd.DataFrame({key: batch[key], "tokens": n})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {kind}, tokens bigint")


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, most: int = BUCKETS) -> np.ndarray:
    """Upper bounds of at most ``most`` buckets with the least padding over a histogram.

    cost(i, j] = length_j * (N_j - N_i) - (S_j - S_i), so the best i for j is on the lower envelope of
    the lines best_i + S_i - N_i * x at x = length_j; slopes fall with i and x grows with j.
    """
    order = np.argsort(lengths)
    x = [float(v) for v in lengths[order]]
    n = [0.0, *np.cumsum(counts[order], dtype=float)]
    s = [0.0, *np.cumsum(lengths[order] * counts[order], dtype=float)]
    size = len(x)
    best = [0.0] + [np.inf] * size
    chosen = []
    for _ in range(min(most, size)):
        new, back = [np.inf] * (size + 1), [0] * (size + 1)
        new[0] = 0.0
        lines: list[tuple[float, float, int]] = []
        head = 0
        for j in range(1, size + 1):
            i = j - 1
            if best[i] < np.inf:
                slope, height = -n[i], best[i] + s[i]
                while len(lines) - head >= 2:
                    (a1, b1, _), (a2, b2, _) = lines[-2], lines[-1]
                    if (height - b1) * (a1 - a2) <= (b2 - b1) * (a1 - slope):
                        lines.pop()
                    else:
                        break
                lines.append((slope, height, i))
            at = x[j - 1]
            while len(lines) - head >= 2 and lines[head + 1][0] * at + lines[head + 1][1] <= lines[head][0] * at + lines[head][1]:
                head += 1
            if len(lines) > head:
                slope, height, i = lines[head]
                new[j], back[j] = slope * at + height + at * n[j] - s[j], i
        best = new
        chosen.append(back)
    bounds, j = [], size
    for back in reversed(chosen):
        if j <= 0:
            break
        bounds.append(x[j - 1])
        j = back[j]
    return np.array(sorted(bounds), np.int64)


def padding(lengths: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> int:
    return int(((bounds[np.searchsorted(bounds, lengths)] - lengths) * counts).sum())


def plan(bounds: np.ndarray, counts: np.ndarray, capacity: int, mix: bool = True) -> list[tuple[int, int, int, int, int]]:
    """Which containers the items of each bucket go to: (bucket, from, to, each, first container).

    Items from..to-1 of the bucket fill consecutive containers with ``each`` of them in a container.
    """
    open_by_room: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # room -> (containers, content)
    done: list[tuple[int, tuple]] = []
    for bucket in range(len(bounds) - 1, -1, -1):
        size, left = int(bounds[bucket]), int(counts[bucket])
        if mix:
            for room in sorted(r for r in open_by_room if r >= size):
                fits, kinds = room // size, open_by_room.pop(room)
                for number, content in kinds:
                    full, rest = divmod(left, fits) if number * fits > left else (number, 0)
                    if full:
                        open_by_room[room - fits * size].append((full, (*content, (bucket, fits))))
                    if rest:
                        open_by_room[room - rest * size].append((1, (*content, (bucket, rest))))
                    if number > full + bool(rest):
                        open_by_room[room].append((number - full - bool(rest), content))
                    left -= full * fits + rest
                if not left:
                    break
        fits = capacity // size
        full, rest = divmod(left, fits)
        if full:
            open_by_room[capacity - fits * size].append((full, ((bucket, fits),)))
        if rest:
            open_by_room[capacity - rest * size].append((1, ((bucket, rest),)))
    for room in sorted(open_by_room):
        done += open_by_room[room]
    used, out, first = defaultdict(int), [], 0
    for number, content in done:
        for bucket, each in content:
            out.append((bucket, used[bucket], used[bucket] + number * each, each, first))
            used[bucket] += number * each
        first += number
    return out


def pieces(items: DataFrame, specs: DataFrame, key: str) -> DataFrame:
    """(spec_name, capacity, key, piece_no, token_start, tokens): every item once for each container
    size, cut at multiples of the capacity only if it is longer. ``specs`` has a few rows."""
    rows = items.where("tokens > 0").withColumn("__one", F.lit(1))
    rows = rows.join(F.broadcast(specs.select("spec_name", "capacity", F.lit(1).alias("__one"))), "__one")
    cuts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.col("capacity").cast("bigint")))
    rows = rows.select("spec_name", "capacity", key, "tokens", cuts.alias("token_start"))
    return rows.select(
        "spec_name", "capacity", key, (F.expr("token_start div capacity") + 1).cast("int").alias("piece_no"),
        "token_start", F.least(F.col("tokens") - F.col("token_start"), F.col("capacity").cast("bigint")).alias("tokens"),
    )


def pack(items: DataFrame, specs: DataFrame, key: str, buckets: int = BUCKETS, mix: bool = True) -> DataFrame:
    """Items(key, tokens) into the containers of specs(spec_name, capacity).

    Gives (spec_name, capacity, container_id, bucket_tokens, key, piece_no, token_start, tokens). No
    container holds more than its capacity. Items without tokens need no place and give no row; equal
    lengths are ordered by key. Keys must be unique. Specs without a positive capacity are left out.
    """
    spark = items.sparkSession
    specs = specs.where("capacity > 0").dropDuplicates(["spec_name"])
    cut = pieces(items, specs, key)
    # at most one row for each length up to the capacity, of each spec
    histogram = cut.groupBy("spec_name", "capacity", "tokens").count().toPandas()
    bounds_rows, ranges, total = [], [], int(histogram["count"].sum())
    for (spec, capacity), h in histogram.groupby(["spec_name", "capacity"]):
        lengths, counts = h["tokens"].to_numpy(), h["count"].to_numpy()
        bounds = bucket_boundaries(lengths, counts, buckets)
        inside = np.bincount(np.searchsorted(bounds, lengths), counts, len(bounds)).astype(np.int64)
        at = np.searchsorted(bounds, lengths)
        bounds_rows += [(spec, int(n), int(b), int(bounds[b])) for n, b in zip(lengths, at)]
        ranges += [(spec, *map(int, r)) for r in plan(bounds, inside, int(capacity), mix)]
    bounds_df = spark.createDataFrame(bounds_rows, "spec_name string, tokens bigint, bucket int, bucket_tokens bigint")
    ranges_df = spark.createDataFrame(
        ranges, "spec_name string, bucket int, `from` bigint, `to` bigint, each bigint, first bigint"
    )
    slots = max(8, total // ITEMS_A_SLOT)
    placed = cut.join(F.broadcast(bounds_df), ["spec_name", "tokens"])
    placed = placed.withColumn("slot", F.pmod(F.xxhash64(key, "piece_no"), F.lit(slots)).cast("int"))
    part = ["spec_name", "bucket", "slot"]
    offsets = placed.groupBy(*part).count()
    before = Window.partitionBy("spec_name", "bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(*part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy(*part).orderBy(F.desc("tokens"), key, "piece_no"))
    placed = placed.withColumn("number", number).join(offsets, part)
    placed = placed.withColumn("at", F.col("number") - 1 + F.col("offset"))
    ranges_df = F.broadcast(ranges_df.withColumnsRenamed({"spec_name": "r_spec", "bucket": "r_bucket"}))
    placed = placed.join(
        ranges_df,
        (F.col("spec_name") == F.col("r_spec")) & (F.col("bucket") == F.col("r_bucket"))
        & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("to")),
    )
    container = F.expr("first + (at - `from`) div each")
    return placed.select(
        "spec_name", "capacity", container.alias("container_id"), "bucket_tokens", key, "piece_no", "token_start", "tokens"
    )
