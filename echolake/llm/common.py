"""Helpers shared by the corpus operators: Arrow passes over rows, stored intermediate tables, word splitting."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echolake.session import scratch_path

#: Text handled in one step of an Arrow pass; bounds a worker's memory whatever the batch size of the session.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table once to the shared folder and read it back, so that later branches do not compute it again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, so that tasks of one worker share it."""
    holder = sys.modules.setdefault("_echolake_worker_cache", types.ModuleType("_echolake_worker_cache"))
    return holder.__dict__.setdefault(name, {})


def begin_pass(owner: str) -> None:
    """Drop what another operator has left in this worker: workers live on between stages, and one operator's caches are of no use to the next."""
    state = worker_cache("owner")
    if state.get("name", owner) != owner:
        for kept in sys.modules["_echolake_worker_cache"].__dict__.values():
            if isinstance(kept, dict):
                kept.clear()
        give_back()
    state["name"] = owner


def give_back() -> None:
    """Return memory that a worker has freed to the system; workers live on between tasks, and an executor's memory counts all of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have no such function
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about `limit` bytes of one column; a longer row stands alone."""
    column = batch.column(text)
    lengths = pa.compute.binary_length(column).fill_null(0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def add_columns(df: DataFrame, text: str, fields: list[T.StructField], fn: Callable[[list[str]], list]) -> DataFrame:
    """Append columns computed from one text column; columns of the same name are replaced.

    `fn` gets the texts of some rows (null: empty) and returns one Arrow array or list per field.
    """
    new = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in new]
    hidden = "__text"
    while hidden in df.columns:
        hidden += "_"
    source = df.select(*[F.col(f"`{f.name}`") for f in keep], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(hidden))
    types_ = [_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in keep] + [f.name for f in fields]

    owner = fn.__module__

    def run(batches):
        begin_pass(owner)
        for batch in batches:
            for part in slices(batch, hidden):
                made = fn(part.column(hidden).to_pylist())
                made = [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types_)]
                yield pa.RecordBatch.from_arrays(part.columns[:-1] + made, names=names)
        give_back()

    return source.mapInArrow(run, T.StructType(keep + fields))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def lists_of(flat, lengths) -> pa.Array:
    """An Arrow list array from the flat values and the length of each list."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def bucket_of(column: Column, parts: int) -> Column:
    """crc32 of the decimal id modulo `parts`: the fold of a row."""
    return F.crc32(column.cast("string").cast("binary")) % parts


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen last."""

    most = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 0)
        return value


def word_hashes(words: list[bytes]):
    """An unsigned 64-bit hash for each word."""
    import numpy as np

    table_ = worker_cache("hashes").setdefault("table", WordHashes())
    return np.fromiter(map(table_.__getitem__, words), np.uint64, len(words))


def run_hashes(words, length: int, seed: int = 0):
    """A 64-bit hash of every run of `length` word hashes."""
    import numpy as np

    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    out = np.full(n, np.uint64(seed + 1))
    for i in range(length):
        out = out * factor + words[i : i + n]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(33)
    return out
