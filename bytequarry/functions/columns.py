"""Column functions over bytes that Catalyst evaluates by itself: one row in, one row out, no shuffle and no Python.

A byte array is array<int> of 0..255 in order. The relational forms in plans.relational say the same over exploded bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_array(content: Column) -> Column:
    """Bytes of a binary column; empty for empty, null for null."""
    # Latin-1 has one character for each byte; split once, so that no lambda sees the whole content.
    letters = F.split(F.decode(content, "ISO-8859-1"), "")
    return F.when(F.octet_length(content) > 0, F.transform(letters, lambda c: F.ascii(c))).when(content.isNotNull(), F.array().cast("array<int>"))


def hex_of(values: Column) -> Column:
    """Upper-case hexadecimal string of a byte array."""
    return F.array_join(F.transform(values, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), "")


def pack(values: Column) -> Column:
    """Binary of a byte array."""
    return F.unhex(hex_of(values))


def before(values: Column) -> Column:
    """Each byte's predecessor, 0 for the first."""
    return F.slice(F.concat(F.array(F.lit(0)), values), F.lit(1), F.size(values))


def delta(values: Column) -> Column:
    return F.zip_with(values, before(values), lambda b, p: F.pmod(b - p, F.lit(256)))


def undelta(values: Column) -> Column:
    """Running sum modulo 256."""
    start = F.named_struct(F.lit("sum"), F.lit(0), F.lit("out"), F.array().cast("array<int>"))

    def step(state: Column, d: Column) -> Column:
        value = F.pmod(state["sum"] + d, F.lit(256))
        return F.named_struct(F.lit("sum"), value, F.lit("out"), F.concat(state["out"], F.array(value)))

    return F.aggregate(values, start, step, lambda s: s["out"])


def unrle(values: Column) -> Column:
    """Expands (count, byte) pairs; odd lengths raise."""
    at = F.sequence(F.lit(1), F.size(values) - 1, F.lit(2))
    runs = F.flatten(F.transform(at, lambda i: F.array_repeat(F.element_at(values, i + 1), F.element_at(values, i))))
    return F.when(F.size(values) % 2 != 0, F.raise_error(F.lit("run-length stream of odd length")).cast("array<int>")).when(F.size(values) > 0, runs).otherwise(values)


def be_uint(value: Column, width: int) -> Column:
    """Big-endian bytes of a non-negative number."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * width, "0"))


FLAGS = ("is_solid", "is_encrypted", "has_deduplication", "has_recovery", "is_multi_volume")


def pack_flags(**flags: Column) -> Column:
    """Bit set of the five archive flags, the first the lowest."""
    out = F.lit(0)
    for bit, name in enumerate(FLAGS):
        out = out.bitwiseOR(F.when(flags[name], 1 << bit).otherwise(0))
    return out


def unpack_flags(bits: Column) -> Column:
    """Struct of the five archive flags; other bits are dropped."""
    return F.struct(*[(bits.bitwiseAND(1 << i) != 0).alias(name) for i, name in enumerate(FLAGS)])


MAGIC = "46495401"
"""Fixed value: the container's first four bytes."""


def header(version: Column, flags: Column, created: Column, entries: Column, chunks: Column, metadata_at: Column, recovery_at: Column) -> Column:
    """The container's 42-byte head."""
    widths = ((version, 2), (flags, 4), (created, 8), (entries, 4), (chunks, 4), (metadata_at, 8), (recovery_at, 8))
    return F.concat(F.unhex(F.lit(MAGIC)), *[be_uint(c, w) for c, w in widths])


def huffman_size(counts: Column) -> Column:
    """Coded size from an array of positive byte counts: 0 for none, 5 for one symbol, else table and payload.

    The payload's bits are the sum of all merges of the two least weights."""
    start = F.named_struct(F.lit("f"), F.array_sort(F.transform(counts, lambda c: c.cast("long"))), F.lit("bits"), F.lit(0).cast("long"))

    def step(state: Column, _: Column) -> Column:
        f = state["f"]
        both = F.element_at(f, 1) + F.element_at(f, 2)
        rest = F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0)))
        return F.named_struct(F.lit("f"), F.array_sort(F.concat(rest, F.array(both))), F.lit("bits"), state["bits"] + both)

    merged = F.aggregate(F.sequence(F.lit(2), F.size(counts)), start, step, lambda s: s["bits"])
    return F.when(F.size(counts) == 0, F.lit(0).cast("long")).when(F.size(counts) == 1, F.lit(5).cast("long")).otherwise(F.lit(1028).cast("long") + F.floor((merged + 7) / 8))


LEVELS = ("Fast", "Balanced", "High", "Ultra", "Extreme", "Research")


def level(name: Column) -> Column:
    """Compression level by name; anything else is Balanced."""
    return F.when(name.isin(*LEVELS), name).otherwise("Balanced")


def solid_mode(name: Column) -> Column:
    return F.when(name == "Solid", "Solid").when(name == "Non-Solid", "NonSolid").otherwise("Auto")


def password(text: Column) -> Column:
    """Null for a blank password."""
    return F.when(F.trim(text) != "", text)


def format_bytes(n: Column) -> Column:
    """'0 B', '1.5 KB', ...: two decimals at most, B to TB."""
    units = F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")])
    power = F.when(n >= 1 << 40, 4).when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1024, 1).otherwise(0)
    value = F.round(n / F.pow(F.lit(1024.0), power), 2)
    shown = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), "\\.$", "")
    return F.when(n == 0, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(units, power + 1)))


def ratio(original: Column, compressed: Column) -> Column:
    """original / compressed, 1 where nothing is stored."""
    return F.when(compressed > 0, original / compressed).otherwise(1.0)


def saved_percent(original: Column, compressed: Column) -> Column:
    return F.when(original > 0, (original - compressed) * 100.0 / original).otherwise(0.0)
