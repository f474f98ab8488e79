"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

_CAPITALS = bytes(range(65, 91))
ASCII_LOWER = bytes.maketrans(_CAPITALS, _CAPITALS.lower())


def texts(column) -> list[bytes]:
    """Values of an Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def total_bytes(df: DataFrame, column: str) -> int:
    """Bytes of all texts of a column: one narrow scan, one number."""
    row = df.agg(F.sum(F.octet_length(column)).alias("n")).first()
    return int(row.n or 0)


def parts_of(size: int, part: int) -> int:
    return max(1, -(-size // part))


def temporary(name: str) -> str:
    """A working column name that no input column can have by accident."""
    return f"__sw_{name}"


def grouped(batches: Iterator, key: str) -> Iterator:
    """Arrow batches sorted by ``key`` -> the same rows cut so that no key is split between pieces.

    Holds one piece and one unfinished key; callers bound the rows of a key.
    """
    import numpy as np
    import pyarrow as pa

    rest: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last > 0 or (rest and rest[-1].column(key)[0].as_py() != keys[0]):
            done = [*rest, batch.slice(0, last)] if last else rest
            yield pa.Table.from_batches(done).combine_chunks()
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def sql_name(name: str) -> str:
    return "`" + re.sub("`", "``", name) + "`"
