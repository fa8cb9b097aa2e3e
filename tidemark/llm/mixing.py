"""Mixing sources to target shares of the total size.

Documents of a source are packed, in a pseudorandom order, into blocks of a
fixed number of tokens: a document belongs to the block in which it starts.
The output is a row of slots, cut into shards; how many of its slots each
source fills is drawn for each shard from a multinomial distribution over what
is left of each source. The j-th slot of a source takes the block at place j
of a pseudorandom permutation of the source's block numbers (its next pass over
the source once all are used), and a join by block number brings the
documents. A source gets as many slots as come nearest to its share of the
tokens, and no more than its blocks times max_repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.encoding import encode_texts
from tidemark.session import cut

#: Tokens of a block.
BLOCK = 1024
#: Parts of a source whose running totals are taken apart; bounds the table of offsets.
PARTS = 1024
#: Slots of an output shard, and shards that one task draws.
SHARD_SLOTS, GROUP = 1024, 64
#: Bins in which the tokens of a source's blocks are summed to find where its share ends.
BINS = 1024
SEED = 20_240_601


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: int, key: int, back: bool = False) -> np.ndarray:
    """The places of `index` (each below size) under a pseudorandom permutation of range(size); back: under its inverse.

    A balanced Feistel network over the next even number of bits, walked on
    while it leaves the range; no table of the permutation is ever held.
    """
    half = np.uint64(max(1, (max(size - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for k in keys[::-1] if back else keys:
            left, right = (right ^ (_mixed(left + k) & mask), left) if back else (right, left ^ (_mixed(right + k) & mask))
        return (left << half) | right

    out = once(index.astype(np.uint64))
    while (beyond := out >= np.uint64(size)).any():
        out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def _key(seed: int, turn: int, source: str) -> int:
    return zlib.crc32(f"{seed}/{turn}/{source}".encode())


@F.pandas_udf(T.LongType())
def _permuted(slot: pd.Series, blocks: pd.Series, source: pd.Series, seed: pd.Series) -> pd.Series:
    out = np.zeros(len(slot), np.int64)
    turn = slot // blocks
    for (name, n, key, k), own in slot.groupby([source, blocks, seed, turn], dropna=False).indices.items():
        out[own] = permuted((slot.iloc[own] - k * n).to_numpy(np.int64), int(n), _key(key, k, name))
    return pd.Series(out)


#: Called so that no filter on its result is moved below it, which would permute every slot twice.
_block = _permuted.asNondeterministic()


@F.pandas_udf(T.LongType())
def _place(block: pd.Series, blocks: pd.Series, source: pd.Series, seed: pd.Series, turn: pd.Series) -> pd.Series:
    """The slot within a pass over its source that takes a block."""
    out = np.zeros(len(block), np.int64)
    for (name, n, key, k), own in block.groupby([source, blocks, seed, turn], dropna=False).indices.items():
        out[own] = permuted(block.iloc[own].to_numpy(np.int64), int(n), _key(key, k, name), back=True)
    return pd.Series(out)


def _drawn(random: np.random.Generator, left: np.ndarray, take: int) -> np.ndarray:
    """How many of `take` slots each source fills: a multinomial draw over what is left; what a source lacks is drawn again over the others."""
    out = np.zeros_like(left)
    while take:
        rest = left - out
        new = np.minimum(random.multinomial(take, rest / rest.sum()), rest)
        out += new
        take -= int(new.sum())
    return out


def draws(slots: list[int], size: int, seed: int) -> Iterator[np.ndarray]:
    """How many of each `size` slots, one after the other, each source fills, until all slots of all sources are used up."""
    left, random = np.array(slots, np.int64), np.random.default_rng(seed)
    while left.sum() > 0:
        drawn = _drawn(random, left, int(min(size, left.sum())))
        left = left - drawn
        yield drawn


def shard_counts(group: int, slots: list[int], seed: int = SEED) -> np.ndarray:
    """The shards of one group: how many slots of each shard each source fills (shards x sources)."""
    return np.array(list(draws(slots, SHARD_SLOTS, (seed << 32) + group)), np.int64).reshape(-1, len(slots))


@dataclass(frozen=True)
class Mix:
    """chosen: documents with their repeats; shares: the report by source; placed: each copy with its shard and slot."""

    chosen: DataFrame
    shares: DataFrame
    placed: DataFrame


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, doc: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = SEED) -> Mix:
    """Documents whose tokens make up the target shares of `total` tokens (None: as many as all sources hold).

    targets: source, target_share, max_repeats; a handful of rows, read on the
    driver. Each source is to give its share of the total; one that cannot,
    with every document used max_repeats times, gives all it has and the
    others do not make up for it. Documents of no target source, with a null
    source, or without tokens (null and empty texts) are not used. Documents
    are used whole. Repeated rows are documents of their own.

    chosen: doc_id, source, tokens (of one copy), repeats. shares: source,
    target_share, actual_share, wanted_tokens, tokens, available_tokens,
    documents, max_repeats, most_repeats, met (it gives what is wanted, but
    for less than a block).

    The documents' token numbers are written once to the checkpoint folder;
    everything else follows from that small table.
    """
    wanted = {r["source"]: (float(r["target_share"]), int(r["max_repeats"])) for r in targets.where(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").collect()}
    spark = documents.sparkSession
    own = documents.select(F.col(doc).alias("__doc"), F.col(source).alias("__source"), F.col(text).alias("__text")).where(F.col("__source").isin(list(wanted)))
    counted = encode_texts(own, ["__doc", "__source"], "__text", ids=None, count="tokens").where("tokens > 0")
    counted = cut(counted.withColumn("__hash", F.xxhash64(F.col("__doc"), F.lit(seed))).withColumn("__bit", F.pmod("__hash", F.lit(PARTS))))
    # running totals in two steps: over a bounded table of parts, then within each part
    parts = counted.groupBy("__source", "__bit").agg(F.sum("tokens").alias("__sum"))
    ahead = Window.partitionBy("__source").orderBy("__bit").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__source", "__bit", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__source", "__bit").orderBy("__hash", "__doc").rowsBetween(Window.unboundedPreceding, -1)
    packed = counted.withColumn("__before", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(F.broadcast(offsets), ["__source", "__bit"])
    packed = packed.select("__doc", "__source", "tokens", F.floor((F.col("__offset") + F.col("__before")) / block).alias("__block"))
    held = {r["__source"]: int(r["n"]) for r in parts.groupBy("__source").agg(F.sum("__sum").alias("n")).collect()}
    total = sum(held.values()) if total is None else int(total)
    names = sorted(wanted)
    blocks = {s: -(-held.get(s, 0) // block) for s in names}
    slots = _slots(packed, names, wanted, held, blocks, total, seed)
    # the driver draws for groups of shards, each group's task for its shards
    drawn_groups = list(draws(slots, SHARD_SLOTS * GROUP, seed))
    groups = np.array(drawn_groups, np.int64).reshape(len(drawn_groups), len(slots))
    first = np.cumsum(groups, axis=0) - groups
    table = spark.createDataFrame([(k, groups[k].tolist(), first[k].tolist()) for k in range(len(groups))], "number bigint, counts array<bigint>, first array<bigint>")

    def expanded(batches):
        for batch in batches:
            for row in batch.itertuples():
                counts = shard_counts(row.number, list(row.counts), seed)
                starts = np.array(row.first, np.int64) + np.cumsum(counts, axis=0) - counts
                shard, source = np.nonzero(counts)
                yield pd.DataFrame({"shard": row.number * GROUP + shard, "__source": [names[i] for i in source], "blocks": [blocks[names[i]] for i in source], "first": starts[shard, source], "n": counts[shard, source]})

    shards = table.repartition(max(1, len(groups)), "number").mapInPandas(expanded, "shard bigint, __source string, blocks bigint, first bigint, n bigint")
    every = shards.select("shard", "__source", "blocks", F.lit(seed).cast("bigint").alias("seed"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))
    drawn = every.select("shard", "slot", "__source", _block("slot", "blocks", "__source", "seed").alias("__block"))
    # the planner takes the slots for few, as it sees only the table of shards; they grow with the data, so they are not broadcast
    drawn = drawn.hint("merge")
    used = drawn.groupBy("__source", "__block").agg(F.count(F.lit(1)).alias("repeats")).hint("merge")
    chosen = packed.join(used, ["__source", "__block"]).select(F.col("__doc").alias(doc), F.col("__source").alias(source), "tokens", "repeats")
    placed = packed.join(drawn, ["__source", "__block"]).select("shard", "slot", F.col("__source").alias(source), F.col("__doc").alias(doc), "tokens")
    goal = spark.createDataFrame([(s, wanted[s][0], wanted[s][1], int(round(wanted[s][0] * total)), held.get(s, 0)) for s in names], "source string, target_share double, max_repeats int, wanted_tokens bigint, available_tokens bigint")
    got = chosen.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    report = goal.join(got, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row for each target source
    shares = report.select(
        "source",
        "target_share",
        F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("actual_share"),
        "wanted_tokens",
        "tokens",
        "available_tokens",
        "documents",
        "max_repeats",
        "most_repeats",
        (F.col("tokens") + block > F.col("wanted_tokens")).alias("met"),
    )
    return Mix(chosen, shares, placed)


def _slots(packed: DataFrame, names: list[str], wanted: dict, held: dict, blocks: dict, total: int, seed: int) -> list[int]:
    """How many slots of each source come nearest to its share of the tokens.

    Whole passes over a source hold what it has. Where its last pass ends
    follows from the sums of its blocks' tokens in the order of that pass: by
    BINS bins of places, then within one of these, until a bin is one place.
    """
    passes, rest = {}, {}
    for s in names:
        goal = wanted[s][0] * total
        passes[s] = min(int(goal // held[s]), wanted[s][1]) if held.get(s) else 0
        if held.get(s) and passes[s] < wanted[s][1]:
            rest[s] = goal - passes[s] * held[s]
    turns = packed.sparkSession.createDataFrame([(s, passes[s], blocks[s], seed) for s in rest], "__source string, __turn bigint, __n bigint, __seed bigint")
    sized = packed.groupBy("__source", "__block").agg(F.sum("tokens").alias("size")).join(F.broadcast(turns), "__source")  # a row for each target source
    sized = cut(sized.select("__source", _place("__block", "__n", "__source", "__seed", "__turn").alias("place"), "size"))
    low, width, ends = dict.fromkeys(rest, 0), {s: blocks[s] for s in rest}, {}
    while low:
        step = {s: -(-width[s] // BINS) for s in low}
        within = [F.when((F.col("__source") == s) & (F.col("place") >= low[s]) & (F.col("place") < low[s] + width[s]), F.floor((F.col("place") - low[s]) / step[s])) for s in low]
        sums = sized.withColumn("bin", F.coalesce(*within)).where("bin is not null").groupBy("__source", "bin").agg(F.sum("size").alias("n")).orderBy("__source", "bin").collect()  # BINS for each target source
        found = dict.fromkeys(low)
        for r in sums:
            s = r["__source"]
            if found[s] is None:
                if rest[s] < r["n"]:
                    found[s] = r["bin"], r["n"]
                else:
                    rest[s] -= r["n"]
        for s, hit in found.items():
            if hit is None or step[s] == 1:
                # the place at which the share ends is taken if that comes nearer
                ends[s] = low[s] + width[s] if hit is None else low[s] + hit[0] + (2 * rest[s] > hit[1])
            else:
                low[s], width[s] = low[s] + hit[0] * step[s], min(step[s], low[s] + width[s] - (low[s] + hit[0] * step[s]))
        low, width = {s: v for s, v in low.items() if s not in ends}, {s: v for s, v in width.items() if s not in ends}
    return [passes[s] * blocks[s] + ends.get(s, 0) for s in names]
