"""What the corpus operators share: the word pattern, the document columns, fast word hashes."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.materialize import new_folder

WORD = r"[^\x20\x09-\x0D]+"


def body(column: str = "text") -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class WordHashes(dict):
    """64-bit hash of a word (UTF-8 bytes), remembered up to a bound on entries."""

    def __init__(self, most: int = 1 << 20):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of a common 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; order matters."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = scramble(out + h[j:j + n] + np.uint64(j + 1))
    return out
