"""Near-duplicates by SimHash with pigeonring filtering.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Two fingerprints within `distance` bits differ, on
a ring of `distance + 1` segments, by at most l * distance / segments bits over every first l segments of some chain. Such a
chain starts with an equal segment and goes on with one that differs in one bit at most, so rows are dealt out by chain, first
segment and the second one without one of its bits. Rows that meet are compared along the whole chain, then in full; of the
links found in a task only those that join two sets leave it. Components of links between distinct fingerprints come from star
joins. Equal fingerprints are one node, so copies never multiply.

Null is read as an empty text; texts without words have fingerprint zero and are linked like any other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, begin_pass, give_back, stored
from .components import components

DISTANCE = 4
WORDS = 4
SEED = 42


def fingerprint(text: str, words: int = WORDS) -> int:
    """64 bits as a signed number."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = np.asarray([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        block = hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `fp`."""
    return add_columns(df, text, [T.StructField("fp", T.LongType())], lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())])


def segments(distance: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments that cut 64 bits as evenly as can be, from the low end."""
    n, out, at = distance + 1, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        out.append((at, width))
        at += width
    return out


def _chains(distance: int) -> list[list[tuple[np.int64, int]]]:
    """For each start on the ring: the mask of the first l segments and the bits that may differ in it."""
    ring, out = segments(distance), []
    for i in range(len(ring)):
        mask, steps = 0, []
        for l in range(1, len(ring) + 1):
            shift, width = ring[(i + l - 1) % len(ring)]
            mask |= ((1 << width) - 1) << shift
            steps.append((np.uint64(mask), l * distance // len(ring)))
        out.append(steps)
    return out


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`a`, `b`: links within `distance` bits between distinct values of `fp`, enough to join whatever is connected."""
    if not 3 <= distance <= 7:
        raise ValueError("a distance of 3 to 7 bits: below, a chain's second segment may not differ at all, above, in several bits")
    ring = segments(distance)
    keys = []
    for i, (shift, width) in enumerate(ring):
        shift2, width2 = ring[(i + 1) % len(ring)]
        first = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        second = F.shiftrightunsigned("fp", shift2).bitwiseAND(F.lit((1 << width2) - 1))
        for bit in range(width2):
            head = i * 64 + bit
            keys.append(F.lit(head << 48).bitwiseOR(F.shiftleft(first, 24)).bitwiseOR(second.bitwiseAND(F.lit(~(1 << bit)))))
    dealt = prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key"))
    chains = _chains(distance)
    owner = __name__

    def meet(batches):
        begin_pass(owner)
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
            f = np.concatenate([held_f, batch.column("fp").to_numpy(zero_copy_only=False)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on in the next batch
            held_k, held_f = k[cut:], f[cut:]
            yield from _forest(k[:cut], f[:cut], chains, distance)
        yield from _forest(held_k, held_f, chains, distance)
        give_back()

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(meet, schema).distinct()


def _forest(keys: np.ndarray, prints: np.ndarray, chains, distance: int):
    """Links among rows of equal key (sorted) that join two sets of this call."""
    nodes, node = np.unique(prints, return_inverse=True)
    parent = np.arange(len(nodes))
    chain = keys >> 54
    alive = np.arange(len(keys))
    lag, out_a, out_b = 0, [], []

    def roots(x):
        while True:
            up = parent[x]
            if (up == parent[up]).all():
                return parent[up]
            parent[x] = parent[up]

    while True:
        lag += 1
        alive = alive[alive + lag < len(keys)]
        alive = alive[keys[alive] == keys[alive + lag]]
        if not len(alive):
            break
        a, b = alive, alive + lag
        differ = (prints[a] ^ prints[b]).view(np.uint64)
        ok = np.ones(len(a), bool)
        for i, steps in enumerate(chains):
            own = chain[a] == i
            if own.any():
                good = np.ones(int(own.sum()), bool)
                for mask, budget in steps:
                    good &= np.bitwise_count(differ[own] & mask) <= budget
                ok[own] = good
        ok &= np.bitwise_count(differ) <= distance
        a, b = node[a[ok]], node[b[ok]]
        x, y = roots(a), roots(b)
        apart = x != y
        for i, j in {(min(p, q), max(p, q)) for p, q in zip(x[apart].tolist(), y[apart].tolist())}:
            p, q = i, j
            while parent[p] != p:
                p = parent[p]
            while parent[q] != q:
                q = parent[q]
            if p != q:
                parent[max(p, q)] = min(p, q)
                out_a.append(nodes[i])
                out_b.append(nodes[j])
        if len(out_a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a, out_b = [], []
    if out_a:
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def classes(prints: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id") -> DataFrame:
    """`fp`, `component_id` (the smallest id reachable; null where all ids are null) of each distinct fingerprint."""
    firsts = prints.groupBy("fp").agg(F.min(doc_id).alias("first"))
    joined = stored(components(links(prints, distance)), "roots").withColumnRenamed("node", "fp")
    tops = joined.join(firsts, "fp").groupBy("root").agg(F.min("first").alias("top"))
    linked = joined.join(tops, "root").select("fp", "top")
    return firsts.join(linked, "fp", "left").select("fp", F.coalesce("top", "first").alias("component_id"))


def near_duplicates(df: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `fp`, `component_id` per row."""
    prints = stored(fingerprints(df.select(doc_id, text), text).select(doc_id, "fp"), "prints")
    return prints.join(classes(prints, distance, doc_id), "fp").select(doc_id, "fp", "component_id")


def keep_one(df: DataFrame, distance: int = DISTANCE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` without all but the smallest id of each component; of rows with that id and one fingerprint, one stays."""
    columns = df.columns
    prints = stored(fingerprints(df.select(doc_id, text), text).select(doc_id, "fp"), "prints")
    tops = classes(prints, distance, doc_id).select("component_id").distinct()
    name = "__fp"
    marked = fingerprints(df.join(tops, df[doc_id].eqNullSafe(tops["component_id"]), "left_semi").withColumnRenamed("fp", name), text) if "fp" in columns \
        else fingerprints(df.join(tops, df[doc_id].eqNullSafe(tops["component_id"]), "left_semi"), text)
    first = marked.withColumn("__n", F.row_number().over(Window.partitionBy(doc_id, "fp").orderBy("fp"))).where("__n = 1").drop("__n", "fp")
    return (first.withColumnRenamed(name, "fp") if "fp" in columns else first).select(*columns)
