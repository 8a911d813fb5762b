"""Texts in containers of a fixed number of tokens (problem 7).

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most ``capacity`` rows however large
the corpus is; only that histogram goes to the driver. There the Martello-Toth reduction fixes sets that provably
dominate all others that hold the same item, in bulk for equal sizes: an item with which nothing fits; an item with the
partner that fills its container; and, where no three items fit beside it, an item with its largest partner if no two
weigh more, or with its two largest partners if no other two could take their place. Best fit decreasing packs the rest.
The plan is a list of runs "items lo..hi of this size go to containers from c on"; their number depends on the capacity,
not on the number of documents. Documents are ranked within their size over salted buckets, whose number grows with the
corpus so that neither a common size nor the long documents make a hot group, and look their container up.

Defined cases: a text longer than a container is divided at multiples of the capacity, its full pieces take a container
each and the rest is an item; a null or empty text is an item of no tokens, which goes to any container; rows that
repeat a ``doc_id`` count once.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Documents of a bucket; there are 32 buckets at least.
BUCKET_ROWS = 200_000


@lru_cache(maxsize=2)
def encoding(name_or_path: str = TOKENIZER):
    """A public byte-level BPE by its name in the installed vocabulary package, or by the path of its rank file."""
    import os

    import public_tokenizers as P
    import tiktoken

    path = name_or_path if os.path.sep in name_or_path else P.path(name_or_path)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df(doc_id, text)`` as ``(doc_id, tokens)``, one row per ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        e = encoding(tokenizer)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    counted = df.select("doc_id", "text").mapInArrow(run, "doc_id bigint, tokens bigint")
    return counted.groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


def reduce_instance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets, in bulk; takes them out of ``counts`` and returns (sizes of the set, number of containers)."""
    fixed: list[tuple[tuple[int, ...], int]] = []
    sizes = sorted(s for s, n in counts.items() if n > 0)

    def fix(chosen: tuple[int, ...]) -> None:
        need = Counter(chosen)
        k = min(counts[s] // m for s, m in need.items())
        fixed.append((chosen, k))
        for s, m in need.items():
            counts[s] -= m * k
            if not counts[s]:
                sizes.pop(bisect_left(sizes, s))

    for s in sorted(sizes, reverse=True):
        while counts.get(s, 0) > 0 and (chosen := _dominating(sizes, counts, s, capacity - s)):
            fix(chosen)
    return fixed


def _dominating(sizes: list[int], counts: dict[int, int], s: int, room: int) -> tuple[int, ...] | None:
    """A set with an item of size ``s`` that no other set with it can beat, or None where none is proven to be one.

    A set can't be beaten if what any other puts beside the item can take the places of what it puts there: then both
    can be swapped in any packing.
    """
    left = lambda x: counts[x] - (x == s)
    i = bisect_right(sizes, room) - 1
    if i >= 0 and not left(sizes[i]):
        i -= 1
    if i < 0:
        return (s,)
    a = sizes[i]  # the largest item that fits
    if a == room:
        return (s, a)
    three, weight = 3, 0
    for x in sizes:
        k = min(three, left(x))
        three, weight = three - k, weight + k * x
        if not three or weight > room:
            break
    if not three and weight <= room:
        return None  # three or more may fit, which pairs alone don't rule out
    if not _pair_beats(sizes, left, a, room):
        return (s, a)
    j = bisect_right(sizes, room - a) - 1
    while j >= 0 and left(sizes[j]) - (sizes[j] == a) < 1:
        j -= 1
    if j < 0:
        return None
    b = sizes[j]  # the largest that fits beside both
    two, weight = 2, 0
    for x in sizes[j + 1 :]:
        k = min(two, left(x))
        two, weight = two - k, weight + k * x
        if not two:
            break
    return (s, a, b) if two or weight > room else None


def _pair_beats(sizes: list[int], left, best: int, room: int) -> bool:
    """Do two items fit that weigh more together than ``best``?"""
    a, b = 0, bisect_right(sizes, room) - 1
    while a <= b:  # the heaviest pair within the room, by two pointers
        x, y = sizes[a], sizes[b]
        if x + y > room or left(y) < 1:
            b -= 1
        elif left(x) < 1 + (a == b):
            a += 1
        elif x + y > best:
            return True
        else:
            a += 1
    return False


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first rank, number, first container) and the number of containers, for counts of sizes 1..capacity."""
    counts = {int(s): int(n) for s, n in histogram.items() if s > 0 and n > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int]] = []
    containers = 0

    def put(size: int, n: int, first: int) -> None:
        runs.append((size, used[size], n, first))
        used[size] += n

    for sizes, n in reduce_instance(counts, capacity):
        for s in sizes:
            put(s, n, containers)
        containers += n
    # Best fit decreasing over groups of containers that have the same room; a group is a list of ranges.
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    rooms: list[int] = []

    def add(room: int, first: int, n: int) -> None:
        if not groups[room]:
            insort(rooms, room)
        groups[room].append((first, n))

    for s in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                whole, rest = divmod(left, per)
                for _ in range(per if whole else 0):
                    put(s, whole, containers)
                if whole:
                    add(capacity - per * s, containers, whole)
                    containers += whole
                for _ in range(rest):
                    put(s, 1, containers)
                if rest:
                    add(capacity - rest * s, containers, 1)
                    containers += 1
                left = 0
                continue
            room = rooms[i]
            first, n = groups[room].pop()
            k = min(n, left)
            put(s, k, first)
            left -= k
            if n > k:
                groups[room].append((first + k, n - k))
            if not groups[room]:
                rooms.pop(i)
            add(room - s, first, k)
    return runs, containers


def pack(df: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, buckets: int | None = None) -> DataFrame:
    """``df(doc_id, text)`` as ``(doc_id, piece_no, pieces, tokens, token_start, container)``, one row per piece."""
    return _assign(token_counts(df, tokenizer), capacity, buckets)


def _assign(counted: DataFrame, capacity: int, buckets: int | None = None) -> DataFrame:
    # Written once, so that counts and ranks are of the same rows and the tokenizer runs once.
    counted = checkpointed(counted)
    buckets = buckets or max(32, -(-counted.count() // BUCKET_ROWS))
    items = counted.select("doc_id", "tokens", (F.col("tokens") % capacity).alias("size"), F.floor(F.col("tokens") / capacity).alias("full"), F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket"))
    per = checkpointed(items.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("n_full")))
    histogram = {r["size"]: r["n"] for r in per.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, containers = plan_containers(histogram, capacity)
    before = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = per.select("size", "bucket", before("n").alias("before"))
    w = Window.partitionBy("size", "bucket").orderBy("doc_id")
    ranked = items.withColumn("rank", F.row_number().over(w) - 1).join(starts, ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    last = ranked.withColumn("container", _lookup(runs)("size", "rank"))
    # Full pieces are numbered after the planned containers, by bucket (a row each) and then within it.
    firsts = per.groupBy("bucket").agg(F.sum("n_full").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + containers)
    firsts = firsts.withColumnRenamed("n", "first_container")
    total = max(1, containers)
    last = last.where("size > 0 or full = 0").select("doc_id", "tokens", "full", F.col("full").alias("piece_no"), (F.col("full") * capacity).alias("token_start"), F.when(F.col("size") > 0, F.col("container")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(total))).alias("container"), (F.col("size") > 0).cast("bigint").alias("more"))
    wf = Window.partitionBy("bucket").orderBy("doc_id")
    whole = items.where("full > 0").withColumn("before", F.sum("full").over(wf.rowsBetween(Window.unboundedPreceding, -1)))
    whole = whole.join(firsts, "bucket").withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full") - 1)))
    whole = whole.select("doc_id", "tokens", "full", "piece_no", (F.col("piece_no") * capacity).alias("token_start"), (F.col("first_container") + F.coalesce("before", F.lit(0)) + F.col("piece_no")).alias("container"), (F.col("size") > 0).cast("bigint").alias("more"))
    both = last.unionByName(whole)
    size = F.least(F.lit(capacity), F.col("tokens") - F.col("token_start"))
    return both.select("doc_id", F.col("piece_no").cast("int").alias("piece_no"), F.greatest(F.lit(1), F.col("full") + F.col("more")).cast("int").alias("pieces"), size.alias("tokens"), "token_start", "container")


def _lookup(runs: list[tuple[int, int, int, int]]):
    """Container of (size, rank) by binary search in the runs, which cover every rank of a size."""
    a = np.array(sorted(runs), dtype=np.int64).reshape(-1, 4)
    key = (a[:, 0] << 44) + a[:, 1]
    first = a[:, 3]

    @F.pandas_udf("bigint")
    def container(size, rank):
        import pandas as pd

        if not len(key):
            return pd.Series([None] * len(size), dtype="Int64")
        k = (size.to_numpy(dtype=np.int64) << 44) + rank.to_numpy(dtype=np.int64)
        i = np.maximum(np.searchsorted(key, k, side="right") - 1, 0)
        return pd.Series(first[i] + (k - key[i]))

    return container


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, and the share of unused room."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.ceil(F.sum("t") / capacity).alias("least"), (1 - F.sum("t") / (F.count(F.lit(1)) * capacity)).alias("unused"))
