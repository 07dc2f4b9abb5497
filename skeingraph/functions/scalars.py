"""Scalar functions of the pipeline and the data boundary, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity kinds of keys, and bounds.
KINDS = {"subject": 1, "person": 2, "character": 3}
KEY_BITS, MAX_ID = 24, 1 << 24
FIRST_YEAR, LAST_YEAR = 1900, 2035


def year(date: Column, strict: bool = True) -> Column:
    """Four leading digits; strictly only where ``-`` or the end follows."""
    found = F.regexp_extract(F.coalesce(date, F.lit("")), r"^([0-9]{4})(?:-|$)" if strict else r"^([0-9]{4})", 1)
    return F.nullif(found, F.lit("")).cast("int")


def clamped_year(y: Column) -> Column:
    return F.greatest(F.least(y, F.lit(LAST_YEAR)), F.lit(FIRST_YEAR))


def zero_as_null(col: Column) -> Column:
    return F.nullif(col, F.lit(0))


def array_sum(col: Column) -> Column:
    return F.aggregate(F.transform(F.coalesce(col, F.array().cast("array<bigint>")), lambda x: x.cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def histogram(counts: Column, buckets: int = 10) -> Column:
    """A map from "1".."10" to counts as an array."""
    return F.array(*[F.coalesce(F.try_element_at(counts, F.lit(str(k + 1))), F.lit(0)).cast("long") for k in range(buckets)])


def histogram_mean(buckets: Column) -> Column:
    """The mean bucket number; null without counts."""
    weighed = F.aggregate(F.transform(buckets, lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(array_sum(buckets) > 0, weighed / array_sum(buckets))


def entity_key(kind: str | Column, id_: Column) -> Column:
    """kind << 24 | id; an id out of range is an error."""
    tag = F.lit(KINDS[kind]) if isinstance(kind, str) else kind
    ok = id_.between(0, MAX_ID - 1)
    return F.when(ok, F.shiftleft(tag.cast("long"), KEY_BITS).bitwiseOR(id_.cast("long"))).otherwise(F.raise_error(F.lit("entity id out of range")).cast("long"))


def key_kind(key: Column) -> Column:
    return F.shiftrightunsigned(key, KEY_BITS).cast("int")


def key_id(key: Column) -> Column:
    return key.bitwiseAND(F.lit(MAX_ID - 1))


def ref(owner: str, id_: Column) -> Column:
    return F.concat(F.lit(f"{owner}:"), id_.cast("string"))


def ref_id(col: Column) -> Column:
    """The number of a canonical reference; null for anything else."""
    digits = F.substring_index(col, ":", -1)
    return F.when(digits.rlike("^(0|[1-9][0-9]*)$"), digits.cast("long"))


def size_code(count: Column) -> Column:
    """min(255, round(18 log2(1 + count))), halves to even."""
    return F.least(F.lit(255), F.rint(18 * F.log2(1 + count))).cast("int")


def score_code(score: Column) -> Column:
    """Tenths; anything that is not a whole number of tenths is an error."""
    tenths = F.rint(score * 10)
    return F.when(F.abs(score * 10 - tenths) < 1e-6, tenths.cast("int")).otherwise(F.raise_error(F.lit("score has more than one decimal")).cast("int"))


def flags(*bits: Column) -> Column:
    out = F.lit(0)
    for k, b in enumerate(bits):
        out = out.bitwiseOR(F.when(F.coalesce(b, F.lit(False)), 1 << k).otherwise(0))
    return out


def quantized(value: Column, low: Column, high: Column) -> Column:
    """Affine 16-bit code of a coordinate."""
    span = F.when(high > low, high - low).otherwise(1.0)
    return F.rint((value - low) / span * 65535).cast("int")


def dequantized(code: Column, low: Column, high: Column) -> Column:
    return low + code / 65535 * F.when(high > low, high - low).otherwise(1.0)


def decoded_enum(namespace: Column, code: Column, labels: dict[tuple[str, int], str]) -> Column:
    """The label of (namespace, code), else of (``*``, code), else empty."""
    pairs = F.create_map(*[x for (n, c), label in labels.items() for x in (F.lit(f"{n}\x1f{c}"), F.lit(label))])
    key = lambda n: F.concat(n, F.lit("\x1f"), code.cast("string"))
    return F.coalesce(F.try_element_at(pairs, key(namespace)), F.try_element_at(pairs, key(F.lit("*"))), F.lit(""))


def enum_label(code: Column, labels: dict[int, str]) -> Column:
    """Label of a code; null for null, or for 0 without a label; otherwise ``unknown (code)``."""
    table = F.create_map(*[x for c, label in labels.items() for x in (F.lit(c), F.lit(label))])
    found = F.try_element_at(table, code)
    return F.when(code.isNull(), F.lit(None)).when(found.isNotNull(), found).when(code == 0, F.lit(None)).otherwise(F.concat(F.lit("unknown ("), code.cast("string"), F.lit(")")))


def jitter(value: Column, salt: int = 0) -> Column:
    """A fixed pseudo-random number in [0, 1) for a key."""
    return F.xxhash64(value, F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def presence(*texts: Column) -> Column:
    """A bit for each text that is not empty, the first one lowest."""
    return flags(*[F.coalesce(t, F.lit("")) != "" for t in texts])


#: Fixed value: the rank of a key that has none.
NO_RANK = 0xFFFFFF


def rank_or_none(rank: Column) -> Column:
    """The rank that a left join found, or the sentinel."""
    return F.coalesce(rank, F.lit(NO_RANK)).cast("int")


def rank_set(ranks: Column, universe: int) -> Column:
    """A sorted array of distinct ranks below ``universe`` as the smaller of a list (four bytes a rank) and a bitset (universe / 8 bytes, lowest bit first): struct
    of encoding, count, ranks or bits."""
    own, size = F.array_sort(F.array_distinct(ranks)), -(-universe // 8)
    power = lambda k: F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), k.cast("int") + 1)
    octet = lambda k: F.aggregate(F.filter(own, lambda r: F.floor(r / 8) == k), F.lit(0), lambda s, r: s + power(r % 8))
    bits = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.lpad(F.hex(octet(k)), 2, "0")), ""))
    sparse = F.size(own) * 4 <= size
    return F.struct(F.when(sparse, "ranks").otherwise("bits").alias("encoding"), F.size(own).alias("count"), F.when(sparse, own).alias("ranks"), F.when(~sparse, bits).alias("bits"))


def rank_members(encoded: Column) -> Column:
    """The ranks of an encoded set, in order; the union of two sets is the set of both arrays."""
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(encoded["bits"]) - 1), lambda k: F.struct(k.alias("at"), F.conv(F.hex(F.substring(encoded["bits"], k + 1, F.lit(1))), 16, 10).cast("int").alias("octet")))
    dense = F.flatten(F.transform(octets, lambda o: F.filter(F.array(*[F.when(F.shiftright(o["octet"], b).bitwiseAND(F.lit(1)) == 1, o["at"] * 8 + b) for b in range(8)]), lambda x: x.isNotNull())))
    return F.when(encoded["encoding"] == "ranks", encoded["ranks"]).otherwise(dense)
