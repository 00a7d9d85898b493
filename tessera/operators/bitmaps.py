"""Bitmap commands on binary columns; bit 0 is the highest bit of the first byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(v: Column, i: Column) -> Column:
    """The i-th byte (0-based) as a number, 0 beyond the end."""
    return F.coalesce(F.conv(F.hex(F.substring(v, (i + 1).cast("int"), F.lit(1))), 16, 10).cast("int"), F.lit(0))


def _bytes(v: Column, start: Column | None = None, length: Column | None = None) -> Column:
    """The bytes as an array of numbers."""
    first = start if start is not None else F.lit(0)
    n = length if length is not None else F.octet_length(v)
    return F.when(n > 0, F.transform(F.sequence(first, first + n - 1), lambda i: byte_at(v, i))).otherwise(F.array().cast("array<int>"))


def _binary(a: Column) -> Column:
    return F.unhex(F.aggregate(a, F.lit(""), lambda s, b: F.concat(s, F.lpad(F.hex(b.bitwiseAND(F.lit(255))), 2, "0"))))


def get_bit(v: Column, at: int) -> Column:
    return F.shiftright(byte_at(v, F.lit(at // 8)), 7 - at % 8).bitwiseAND(F.lit(1))


def set_bit(v: Column, at: int, bit: int) -> Column:
    """The value grows with zero bytes up to the bit."""
    v = F.coalesce(v, F.lit(b""))
    size = F.greatest(F.octet_length(v), F.lit(at // 8 + 1))
    mask = 1 << (7 - at % 8)
    changed = F.transform(_bytes(v, F.lit(0), size), lambda b, i: F.when(i == at // 8, b.bitwiseOR(F.lit(mask)) if bit else b.bitwiseAND(F.lit(255 - mask))).otherwise(b))
    return _binary(changed)


def bit_count(v: Column, start: int | None = None, end: int | None = None, unit: str = "byte") -> Column:
    """Set bits, of a range of bytes or bits with both ends included."""
    if start is None:
        return F.aggregate(_bytes(v), F.lit(0), lambda s, b: s + F.bit_count(b))
    size = F.octet_length(v) * (8 if unit == "bit" else 1)
    first = F.greatest(size + start, F.lit(0)) if start < 0 else F.lit(start)
    last = size + end if end < 0 else F.least(F.lit(end), size - 1)
    if unit == "byte":
        return F.aggregate(_bytes(v, first, last - first + 1), F.lit(0), lambda s, b: s + F.bit_count(b))
    return F.when(last < first, 0).otherwise(F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0), lambda s, i: s + F.shiftright(byte_at(v, F.floor(i / 8)), 1).bitwiseAND(F.lit(0)) + _bit(v, i)))


def _bit(v: Column, i: Column) -> Column:
    return F.floor(byte_at(v, F.floor(i / 8)) / F.pow(F.lit(2), 7 - i % 8)).cast("int").bitwiseAND(F.lit(1))


def bit_pos(v: Column, bit: int) -> Column:
    """The first bit so set, -1 if none; for 0 the value counts as if zeros followed."""
    bits = F.flatten(F.transform(_bytes(v), lambda b: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.floor(b / F.pow(F.lit(2), k)).cast("int").bitwiseAND(F.lit(1)))))
    at = F.array_position(bits, bit) - 1
    return F.when((at < 0) & F.lit(bit == 0), F.octet_length(v) * 8).otherwise(at).cast("long")


def bit_op(op: str, *values: Column) -> Column:
    """AND, OR, XOR, NOT, DIFF (first without the others), DIFF1 (others without the first), ANDOR, ONE; short values count as zero-filled."""
    size = F.greatest(*[F.octet_length(v) for v in values]) if len(values) > 1 else F.octet_length(values[0])
    rows = [_bytes(v, F.lit(0), size) for v in values]
    if op.upper() == "NOT":
        return _binary(F.transform(rows[0], lambda b: F.lit(255) - b))

    def fold(parts: list[Column], f) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = F.zip_with(out, p, f)
        return out

    land, lor, xor = (lambda a, b: a.bitwiseAND(b)), (lambda a, b: a.bitwiseOR(b)), (lambda a, b: a.bitwiseXOR(b))
    minus = lambda a, b: a.bitwiseAND(F.lit(255) - b)
    kind = op.upper()
    if kind in ("AND", "OR", "XOR"):
        return _binary(fold(rows, {"AND": land, "OR": lor, "XOR": xor}[kind]))
    if kind == "ONE":
        once, many = rows[0], F.transform(rows[0], lambda b: F.lit(0))
        for r in rows[1:]:
            many = F.zip_with(many, F.zip_with(once, r, land), lor)
            once = F.zip_with(once, r, lor)
        return _binary(F.zip_with(once, many, minus))
    others = fold(rows[1:], lor)
    return _binary(F.zip_with(rows[0], others, {"DIFF": minus, "DIFF1": lambda a, b: b.bitwiseAND(F.lit(255) - a), "ANDOR": land}[kind]))


def bitfield_get(v: Column, kind: str, offset: int) -> Column:
    """An integer of kind u1..u63 or i1..i64 at a bit offset."""
    signed, width = kind[0] == "i", int(kind[1:])
    first, last = offset // 8, (offset + width - 1) // 8
    total = F.lit(0).cast("decimal(38,0)")
    for i in range(first, last + 1):
        total = (total * 256 + byte_at(v, F.lit(i)).cast("decimal(38,0)")).cast("decimal(38,0)")
    shift = 8 * (last + 1) - offset - width
    value = (F.floor(total / F.lit(1 << shift).cast("decimal(38,0)")) % F.lit(1 << width).cast("decimal(38,0)")).cast("decimal(38,0)")
    if signed:
        value = F.when(value >= F.lit(1 << (width - 1)).cast("decimal(38,0)"), value - F.lit(1 << width).cast("decimal(38,0)")).otherwise(value)
    return value.cast("long")


def bitfield_set(v: Column, kind: str, offset: int, value: Column | int) -> Column:
    """The binary with the low bits of value written at the offset."""
    width = int(kind[1:])
    value = value if isinstance(value, Column) else F.lit(value)
    v = F.coalesce(v, F.lit(b""))
    size = F.greatest(F.octet_length(v), F.lit((offset + width - 1) // 8 + 1))
    bits = _bytes(v, F.lit(0), size)
    out = bits
    for k in range(width):
        at, mask = offset + k, 1 << (7 - (offset + k) % 8)
        on = F.shiftright(value.cast("long"), width - 1 - k).bitwiseAND(F.lit(1)) == 1
        out = F.transform(out, _writer(at // 8, mask, on))
    return _binary(out)


def _writer(byte: int, mask: int, on: Column):
    return lambda b, i: F.when(i == byte, F.when(on, b.bitwiseOR(F.lit(mask))).otherwise(b.bitwiseAND(F.lit(255 - mask)))).otherwise(b)


def bitfield_incrby(v: Column, kind: str, offset: int, n: int, overflow: str = "WRAP") -> Column:
    """The new integer: wrapped, held at the limits (SAT), or null (FAIL) beyond the kind's range."""
    signed, width = kind[0] == "i", int(kind[1:])
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    dec = lambda x: F.lit(x).cast("decimal(38,0)")
    total = bitfield_get(v, kind, offset).cast("decimal(38,0)") + dec(n)
    inside = total.between(dec(low), dec(high))
    if overflow == "SAT":
        out = F.greatest(F.least(total, dec(high)), dec(low))
    elif overflow == "FAIL":
        out = F.when(inside, total)
    else:
        out = F.pmod(total - dec(low), dec(1 << width)) + dec(low)
    return out.cast("long")
