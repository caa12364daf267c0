"""Filling fixed-capacity containers with texts: best-fit decreasing with a segment tree over remaining capacities.

Texts are measured in tokens where they lie, in Arrow batches; only (id, tokens) moves on. Texts are dealt into shards by a hash of
their id, size and copy number, so the result does not depend on how the table is partitioned. A shard holds so many tokens that
each capacity fills SHARD_CONTAINERS containers, of which only a few are left badly filled, and at most SHARD_ROWS texts; no shard
grows with the corpus. Each shard is shuffled once and packed for all capacities: a text longer than a container is cut into full
containers and a rest; pieces in decreasing order go to the open container with the least remaining capacity that still holds them,
found in a segment tree whose leaves count the open containers of each remaining capacity.

Defined results: null texts and texts without tokens are in no container; repeated rows are packed one by one, as copies 0, 1, ...;
ties are packed in the order of their ids; an unknown or non-positive capacity gives nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slovotok.session import checkpoint

#: Containers of the largest capacity that a shard fills, and texts that it holds at most (if they are tiny).
SHARD_CONTAINERS, SHARD_ROWS = 500, 200_000
#: Copies of a text that are held as one array.
COPIES = 10_000
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: How the byte-level tokenizers cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(folder: str = TOKENIZERS, name: str = TOKENIZER):
    """A function that counts the tokens of texts."""
    path = f"{folder}/{name}"
    if name.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(coding.encode_ordinary(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def token_counts(documents: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(key, n_tokens) of every text that is not null."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(folder, name)
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "n_tokens": np.array(count(batch["text"].tolist()), np.int64)})

    rows = documents.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {kind}, n_tokens bigint")


class OpenContainers:
    """A segment tree over remaining capacities: which have open containers."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, (capacity + 1).bit_length())
        self.some = bytearray(2 * self.size)
        self.open: dict[int, list[int]] = {}

    def tightest(self, need: int) -> int:
        """The least remaining capacity of at least `need` with an open container; -1 if there is none."""
        some, i = self.some, need + self.size
        if some[i]:
            return need
        while True:
            while i & 1:  # A right child: everything to its right is under an ancestor's right side.
                i >>= 1
                if i <= 1:
                    return -1
            if some[i | 1]:
                i |= 1
                break
            i >>= 1
            if i <= 1:
                return -1
        while i < self.size:
            i <<= 1
            if not some[i]:
                i |= 1
        return i - self.size

    def put(self, remaining: int, container: int) -> None:
        """Opens a container with some capacity left."""
        held = self.open.setdefault(remaining, [])
        held.append(container)
        i = remaining + self.size
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, remaining: int) -> int:
        """Takes out the container that came last to this remaining capacity."""
        held = self.open[remaining]
        container = held.pop()
        if not held:
            some, i = self.some, remaining + self.size
            some[i] = 0
            i >>= 1
            while i and not (some[2 * i] or some[2 * i + 1]):
                some[i] = 0
                i >>= 1
        return container


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item; sizes are at most the capacity."""
    out, containers, n = [0] * len(sizes), OpenContainers(capacity), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        r = containers.tightest(sizes[i])
        if r < 0:
            at, r, n = n, capacity, n + 1
        else:
            at = containers.take(r)
        out[i] = at
        if r > sizes[i]:
            containers.put(r - sizes[i], at)
    return out


def pack(counts: DataFrame, windows: list[tuple[int, int]], containers: int = SHARD_CONTAINERS, most_rows: int = SHARD_ROWS) -> DataFrame:
    """(window_id, container_id, key, piece, start_token, n_tokens) for each (window_id, capacity).

    `counts` has (key, n_tokens). Pieces of a text count from 0; start_token is the offset of a piece in its text."""
    windows = [(w, c) for w, c in windows if c and c > 0]
    kept = checkpoint(counts.filter(F.col("n_tokens") > 0).groupBy("key", "n_tokens").agg(F.count("*").alias("copies")))
    kind = kept.schema["key"].dataType.simpleString()
    schema = f"window_id bigint, container_id bigint, key {kind}, piece int, start_token bigint, n_tokens int"
    n_rows, n_tokens = kept.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") * F.col("n_tokens")), F.lit(0))).first()
    largest = max((c for _, c in windows), default=1)
    shards = max(1, n_tokens // (containers * largest), -(-n_rows // most_rows))
    # In two steps, so that the copies of no text are held as one array.
    tens = kept.select("key", "n_tokens", "copies", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(COPIES).cast("bigint"))).alias("first"))
    rows = tens.select("key", "n_tokens", F.explode(F.sequence("first", F.least(F.col("copies"), F.col("first") + COPIES) - 1)).alias("copy"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("key", "n_tokens", "copy"), F.lit(shards)).cast("int"))

    def packed(key: np.ndarray, n: np.ndarray, shard: int, window: int, capacity: int) -> pd.DataFrame:
        full, rest = n // capacity, n % capacity
        fit = best_fit_decreasing(rest[rest > 0].tolist(), capacity)
        used = max(fit, default=-1) + 1
        rows = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(full) - full, full)
        with_rest = np.flatnonzero(rest > 0)
        order = np.concatenate([rows, with_rest]).astype(np.int64)
        pieces = np.concatenate([piece, full[with_rest]]).astype(np.int64)
        container = np.concatenate([used + np.arange(len(rows)), np.array(fit, np.int64)]).astype(np.int64)
        length = np.concatenate([np.full(len(rows), capacity), rest[with_rest]]).astype(np.int64)
        return pd.DataFrame(
            {
                "window_id": np.int64(window), "container_id": (np.int64(shard) << 32) + container, "key": key[order],
                "piece": pieces.astype(np.int32), "start_token": pieces * capacity, "n_tokens": length.astype(np.int32),
            }
        )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "key", "copy"], ascending=[False, True, True], kind="stable")
        keys, n, shard = group["key"].to_numpy(), group["n_tokens"].to_numpy(), int(group["shard"].iloc[0])
        return pd.concat([packed(keys, n, shard, window, capacity) for window, capacity in windows], ignore_index=True)

    return rows.groupBy("shard").applyInPandas(run, schema) if windows else kept.sparkSession.createDataFrame([], schema)


def stated_windows(windows: DataFrame) -> list[tuple[int, int]]:
    """The capacities as a list; the table is small by definition, and more than a thousand is refused."""
    rows = windows.select("window_id", "capacity_tokens").distinct().orderBy("window_id", "capacity_tokens").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1000 capacities")
    return [(r["window_id"], r["capacity_tokens"]) for r in rows]


def fill_report(packed: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Containers, tokens, share of the room used, and the least number of containers possible, for each capacity."""
    sizes = packed.sparkSession.createDataFrame([(int(w), int(c)) for w, c in windows], "window_id bigint, capacity bigint")
    by = packed.groupBy("window_id").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    least = F.ceil(F.col("n_tokens") / F.col("capacity"))
    return by.join(F.broadcast(sizes), "window_id").select(
        "window_id", "capacity", "n_pieces", "n_containers", least.alias("least_containers"), F.round(F.col("n_tokens") / (F.col("capacity") * F.col("n_containers")), 5).alias("fill")
    )
