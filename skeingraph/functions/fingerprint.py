"""Order-independent, duplicate-sensitive fingerprints of row multisets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: count, the sum of the rows' 128-bit hashes by 32-bit lanes with carries (mod 2^128), and their XOR, in hex."""
    names = columns or df.columns
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")).alias(f"c{k}") for k, c in enumerate(names)])), 256)
    lanes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    sums = df.select(*[x.alias(f"l{k}") for k, x in enumerate(lanes)]).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(F.col(f"l{k}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)], *[F.coalesce(F.bit_xor(f"l{k}"), F.lit(0).cast("long")).alias(f"x{k}") for k in range(4)])
    out, carry = [], F.lit(0).cast("decimal(38,0)")
    for k in (3, 2, 1, 0):  # the last lane is the least significant
        total = F.col(f"s{k}") + carry
        out.append(F.lpad(F.lower(F.hex((total % (1 << 32)).cast("long"))), 8, "0"))
        carry = F.floor(total / (1 << 32)).cast("decimal(38,0)")
    text = F.concat(*reversed(out))
    xor = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"x{k}"))), 8, "0") for k in range(4)])
    return sums.select(F.col("n").alias("rows"), text.alias("sum128"), xor.alias("xor128"))
