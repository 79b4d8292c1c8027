"""Object hashes: a strategy by name, hex codecs and bucket paths."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _xxh128(data: pd.Series) -> pd.Series:
    import xxhash

    return data.map(lambda b: None if b is None else xxhash.xxh3_128_hexdigest(b))


#: Name to (expression of lower-case hex over bytes, bytes of the hash). The last runs in Python; the others in the JVM.
STRATEGIES = {
    "sha256": (lambda b: F.sha2(b, 256), 32),
    "sha1": (lambda b: F.sha1(b), 20),
    "md5": (lambda b: F.md5(b), 16),
    "xxh128": (lambda b: _xxh128(b), 16),
}


def hash_hex(data: Column, strategy: str = "sha256") -> Column:
    return STRATEGIES[strategy][0](data.cast("binary"))


def is_hash(text: Column) -> Column:
    """Whether a text is the hex of some whole bytes, at least one."""
    return text.rlike("^([0-9a-fA-F]{2})+$")


def from_hex(text: Column) -> Column:
    return F.when(is_hash(text), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not a hash: "), text)))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def bucket_path(hash_: Column) -> Column:
    """chunks/<2 digits>/<6 digits>/<all>."""
    return F.concat_ws("/", F.lit("chunks"), F.substring(hash_, 1, 2), F.substring(hash_, 1, 6), hash_)
