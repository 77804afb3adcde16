"""CRC-32C (Castagnoli), which Spark lacks, as a vectorised function of binary columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Fixed value: the reversed Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78


@lru_cache(1)
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


def crc32c_of(data: bytes, start: int = 0) -> int:
    table, c = _table().tolist(), start ^ 0xFFFFFFFF
    for b in data:
        c = table[(c ^ b) & 0xFF] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


@F.pandas_udf(LongType())
def crc32c(content: pd.Series) -> pd.Series:
    """All values of a batch are advanced together, byte by byte."""
    values = [b"" if v is None else bytes(v) for v in content]
    lengths = np.array([len(v) for v in values])
    width = int(lengths.max(initial=0))
    data = np.zeros((len(values), width), np.uint8)
    for i, v in enumerate(values):
        data[i, : len(v)] = np.frombuffer(v, np.uint8)
    c, table = np.full(len(values), 0xFFFFFFFF, np.uint32), _table()
    for k in range(width):
        c = np.where(lengths > k, table[(c ^ data[:, k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8)), c)
    out = (c ^ np.uint32(0xFFFFFFFF)).astype(np.int64)
    return pd.Series([None if v is None else int(x) for v, x in zip(content, out, strict=True)], dtype="Int64")
