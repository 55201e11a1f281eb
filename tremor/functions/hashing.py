"""64-bit FNV-1a, the identity of a symbol, without overflow under ANSI arithmetic.

The state is kept as two 32-bit halves in longs: the prime is 2**40 + 435, so each step is
two small products and a carry.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a parameters (fixed values).
OFFSET_BASIS = 0xCBF29CE484222325
PRIME = 0x100000001B3
LOW = 0xFFFFFFFF


def _state(data: Column) -> Column:
    n = F.octet_length(data)
    octet = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    octets = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), octet)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(OFFSET_BASIS >> 32).cast("long").alias("hi"), F.lit(OFFSET_BASIS & LOW).cast("long").alias("lo"))

    def step(h, b):
        x = h["lo"].bitwiseXOR(b)
        low = x * 435
        high = h["hi"] * 435 + x * 256 + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(LOW)).alias("hi"), low.bitwiseAND(F.lit(LOW)).alias("lo"))

    return F.aggregate(octets, start, step)


def fnv1a64_hex(text: Column) -> Column:
    """16 lowercase hex digits."""
    return F.transform(F.array(_state(F.encode(text, "utf-8"))), lambda h: F.lower(F.format_string("%08x%08x", h["hi"], h["lo"])))[0]


def fnv1a64(text: Column) -> Column:
    """The unsigned value as DECIMAL(20,0)."""
    wide = lambda h: h["hi"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + h["lo"].cast("decimal(20,0)")
    return F.transform(F.array(_state(F.encode(text, "utf-8"))), wide)[0].cast("decimal(20,0)")


def fnv1a64_bytes(data: bytes) -> str:
    """The same of a file's bytes, as hex, for executors that read files."""
    h = OFFSET_BASIS
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
