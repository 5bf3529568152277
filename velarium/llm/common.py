"""What the operators of this folder share: scratch tables, sizes, and vectorised text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from velarium.session import discard, materialize, release  # noqa: F401  for the operators


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def utf8(array: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in array.cast(pa.binary() if pa.types.is_string(array.type) else pa.large_binary()).to_pylist()]


#: Which bytes are white space: space and \t \n \v \f \r.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd, so that it has an inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of x over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, up to n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def words_of(data: bytes, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (bytes) of each run of bytes that keep allows (default: no white space), and a 64-bit hash of each.

    A-Z hash as a-z. Equal words have equal hashes in every process. No bytes: three empty arrays.
    """
    raw = _LOWER[np.frombuffer(data, np.uint8)]
    inside = ~_SPACE[raw] if keep is None else keep[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    up, down = _power_table(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(batches, keys: int):
    """Rows sorted by their first columns -> for each run of equal keys, its columns as arrays (numpy; binary as objects). Null keys aren't allowed."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        change = np.zeros(len(rows[0]) - 1, bool)
        for c in rows[:keys]:
            change |= c[1:] != c[:-1]
        edges = np.concatenate([[0], np.flatnonzero(change) + 1]).tolist()
        for a, b in zip(edges, edges[1:], strict=False):
            yield [c[a:b] for c in rows]
        held = [c[edges[-1] :] for c in rows]
    if held is not None:
        yield held
