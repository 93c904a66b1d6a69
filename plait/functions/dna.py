"""DNA strings, k-mers and graph positions as Column expressions; 64-bit hashes as Arrow UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_FROM, _TO = "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"
#: The same table for single characters; anything else becomes N.
COMPLEMENT = dict(zip(_FROM, _TO, strict=True))


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: Column | str) -> Column:
    """Base by base, with the ambiguity codes; unknown characters become N."""
    return F.translate(F.regexp_replace(_col(seq), f"[^{_FROM}]", "N"), _FROM, _TO)


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def oriented(seq: Column | str, is_rev: Column | str) -> Column:
    """A node's label as it is read in the given orientation."""
    return F.when(_col(is_rev), reverse_complement(seq)).otherwise(_col(seq))


def subsequence(seq: Column, start: Column | int, size: Column | int) -> Column:
    """From a 0-based offset, cut off at the end of the label."""
    at, n = (x if isinstance(x, Column) else F.lit(x) for x in (start, size))
    return F.substring(seq, at + 1, n)


def base_at(seq: Column, i: Column | int) -> Column:
    return subsequence(seq, i, 1)


def starts_with(seq: Column, base: str) -> Column:
    return seq.startswith(base)


def ends_with(seq: Column, base: str) -> Column:
    return seq.endswith(base)


def kmer_key(kmer: Column | str) -> Column:
    """Two bits a base, first base highest, for up to 31 bases: order and equality as of the strings. Other characters: null."""
    k = F.upper(_col(kmer))
    digits = F.translate(k, "ACGT", "0123")
    value = F.aggregate(F.split(digits, ""), F.lit(0).cast("bigint"), lambda acc, c: F.shiftleft(acc, 2) + F.coalesce(c.try_cast("bigint"), F.lit(0)))
    return F.when(k.rlike("^[ACGT]{1,31}$"), value)


def kmer_text(key: Column | str, k: int) -> Column:
    """The k-mer of a key."""
    code = _col(key)
    return F.concat(*(F.substring(F.lit("ACGT"), (F.shiftright(code, 2 * (k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int"), F.lit(1)) for i in range(k)))


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def pack_position(node_id: Column, is_rev: Column, offset: Column) -> Column:
    """64 bits: node id, then one bit of orientation and ten of offset. Offsets over 1023 are an error."""
    fine = F.when(offset > 1023, F.raise_error(F.lit("offset over 1023")).cast("bigint")).otherwise(offset.cast("bigint"))
    return F.shiftleft(node_id.cast("bigint"), 11).bitwiseOR(F.shiftleft(is_rev.cast("bigint"), 10)).bitwiseOR(fine)


def unpack_position(packed: Column) -> Column:
    return F.struct(
        F.shiftrightunsigned(packed, 11).alias("node_id"), (packed.bitwiseAND(F.lit(1024)) != 0).alias("is_rev"), packed.bitwiseAND(F.lit(1023)).cast("int").alias("offset")
    )


def reverse_base(node_id: Column, is_rev: Column, offset: Column, length: Column) -> Column:
    """The same base, seen from the other strand."""
    return F.struct(node_id.alias("node_id"), (~is_rev).alias("is_rev"), (length - 1 - offset).alias("offset"))


def wang_hash(key: np.ndarray) -> np.ndarray:
    """Wang's 64-bit integer hash."""
    h = key.astype(np.uint64)
    u = np.uint64
    with np.errstate(over="ignore"):
        h = ~h + (h << u(21))
        h ^= h >> u(24)
        h = h * u(265)
        h ^= h >> u(14)
        h = h * u(21)
        h ^= h >> u(28)
        return h + (h << u(31))


def downweight(h: np.ndarray, rounds: int) -> np.ndarray:
    """x -> 1 - (1 - x)^(2^rounds) in 64-bit fixed point: frequent k-mers rarely win a window."""
    rest = ~h
    for _ in range(rounds):
        rest = (rest >> np.uint64(32)) ** np.uint64(2)
    return ~rest


@F.pandas_udf(LongType())
def wang_hash_64(key: pd.Series) -> pd.Series:
    """Wang's hash of a column, as the signed integer of the same bits (compare with bit 63 flipped)."""
    return pd.Series(wang_hash(key.to_numpy(np.int64).view(np.uint64)).view(np.int64))
