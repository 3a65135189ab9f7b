"""Expressions to Spark columns. Integers are BIGINT and wrap; x / 0 and x % 0 are 0."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rulespan.plans.program import ProgramError
from rulespan.plans.syntax import Call, Const, Op, Var

INT, STR = "int", "string"


@dataclass(frozen=True)
class Value:
    """A column and its kind: int, string, or the functor of a compound."""

    col: Column
    kind: str


def s64(x: int) -> Column:
    """A 64-bit pattern as a BIGINT literal."""
    x &= (1 << 64) - 1
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def rotl(c: Column, n: int) -> Column:
    return F.shiftleft(c, n).bitwiseOR(F.shiftrightunsigned(c, 64 - n))


def xxh3_int64(v: Column) -> Column:
    """XXH3-64, seed 0, of the 8 little-endian bytes of an integer."""
    h = rotl(v, 32).bitwiseXOR(s64(0x1CAD21F72C81017C ^ 0xDB979083E96DD4DE))
    h = h.bitwiseXOR(rotl(h, 49)).bitwiseXOR(rotl(h, 24)) * s64(0x9FB21C651E98DF25)
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 35) + F.lit(8)) * s64(0x9FB21C651E98DF25)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 28))


def div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", a, b))


def mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(a % b)


def substr(s: Column, start: Column, n: Column) -> Column:
    """From 0, in characters; "" where the start or length is out of range."""
    bad = (start < 0) | (n < 0) | (start > F.char_length(s))
    most = F.least(n, F.char_length(s).cast("long"))
    return F.when(bad, F.lit("")).otherwise(F.substring(s, (start + 1).cast("int"), most.cast("int")))


def to_number(s: Column) -> Column:
    """The number a text begins with, behind white space; 0 without one; beyond 64 bits the nearest."""
    digits = F.regexp_extract(s, r"^[ \t\n\x0B\f\r]*([+-]?\d+)", 1)
    high = F.when(digits.startswith("-"), s64(1 << 63)).otherwise(s64((1 << 63) - 1))
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(F.coalesce(digits.try_cast("long"), high))


CRC_CHUNK = 256


def crc32c_tables():
    """(of a byte, of each byte of a register that goes on by CRC_CHUNK zeros)."""
    import numpy as np

    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = t >> 1 ^ np.where(t & 1, np.uint32(0x82F63B78), np.uint32(0))
    on = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(CRC_CHUNK):
        on = on >> 8 ^ t[on & 255]
    return t, on


def crc32c(texts: list[bytes], tables):
    """Of all texts at once. The first len % CRC_CHUNK bytes of each go through the register byte by byte, of whole
    chunks the remainders are worked out side by side and then put together, chunk after chunk."""
    import numpy as np

    t, on = tables
    size = np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    start = np.cumsum(size) - size
    reg = np.full(len(texts), 0xFFFFFFFF, np.uint32)
    head = size % CRC_CHUNK
    for j in range(int(head.max(initial=0))):
        live = np.flatnonzero(head > j)
        reg[live] = reg[live] >> 8 ^ t[(reg[live] ^ data[start[live] + j]) & 255]
    many = size // CRC_CHUNK
    first = np.cumsum(many) - many
    at = np.repeat(start + head - first * CRC_CHUNK, many) + np.arange(int(many.sum())) * CRC_CHUNK
    rest = np.zeros(len(at), np.uint32)
    for j in range(CRC_CHUNK if len(at) else 0):
        rest = rest >> 8 ^ t[(rest ^ data[at + j]) & 255]
    for k in range(int(many.max(initial=0))):
        live = np.flatnonzero(many > k)
        r = reg[live]
        reg[live] = on[0][r & 255] ^ on[1][r >> 8 & 255] ^ on[2][r >> 16 & 255] ^ on[3][r >> 24] ^ rest[first[live] + k]
    return (reg ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def crc32c_udf():
    def crc(batches):
        import pandas as pd

        tables = crc32c_tables()
        for s in batches:
            yield pd.Series(crc32c([x.encode() for x in s], tables))

    from collections.abc import Iterator

    import pandas as pd

    crc.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(crc, "long")


def hmac_sha256(message: Column, key: str) -> Column:
    """With a key that is known: two digests in the JVM."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def hmac_udf():
    """With keys in a column."""
    import pandas as pd

    def mac(msg, key):
        import hashlib
        import hmac

        return pd.Series([hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for m, k in zip(msg, key)])

    mac.__annotations__ = {"msg": pd.Series, "key": pd.Series, "return": pd.Series}
    return F.pandas_udf(mac, "string")


def uuid5(ns: Column, name: Column) -> Column:
    """RFC 4122 version 5 in the name space that the text ns names (a UUID, or else a name in the DNS space), by SHA-1 in the JVM."""
    plain = F.lower(F.regexp_replace(ns, "-", ""))
    dns = "6ba7b8109dad11d180b400c04fd430c8"

    def digest(space: Column, text: Column) -> Column:
        h = F.sha1(F.concat(F.unhex(space), F.encode(text, "UTF-8")))
        nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
        return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.lower(F.hex(nibble)), F.substring(h, 18, 15))

    space = F.when(plain.rlike("^[0-9a-f]{32}$"), plain).otherwise(digest(F.lit(dns), ns))
    h = digest(space, name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase
truth = lambda c: c.cast("int").cast("long")

#: name: (kinds of arguments, kind of the result, columns -> column); * takes either kind
TABLE: dict[str, tuple[tuple[str, ...], str, Callable]] = {
    "band": ((INT, INT), INT, lambda a, b: a.bitwiseAND(b)),
    "bor": ((INT, INT), INT, lambda a, b: a.bitwiseOR(b)),
    "bxor": ((INT, INT), INT, lambda a, b: a.bitwiseXOR(b)),
    "bnot": ((INT,), INT, F.bitwise_not),
    "bshl": ((INT, INT), INT, lambda a, b: F.call_function("shiftleft", a, b.cast("int"))),
    "bshr": ((INT, INT), INT, lambda a, b: F.call_function("shiftright", a, b.cast("int"))),
    "md5": (("*",), STR, lambda s: F.md5(F.encode(s.cast("string"), "UTF-8"))),
    "sha1": (("*",), STR, lambda s: F.sha1(F.encode(s.cast("string"), "UTF-8"))),
    "sha256": (("*",), STR, lambda s: F.sha2(F.encode(s.cast("string"), "UTF-8"), 256)),
    "sha512": (("*",), STR, lambda s: F.sha2(F.encode(s.cast("string"), "UTF-8"), 512)),
    "hmac_sha256": (("*", "*"), STR, lambda m, k: hmac_udf()(m.cast("string"), k.cast("string"))),
    "uuid4": ((), STR, lambda: F.uuid()),
    "uuid5": (("*", "*"), STR, lambda n, s: uuid5(n.cast("string"), s.cast("string"))),
    "crc32_ethernet": ((STR,), INT, lambda s: F.crc32(F.encode(s, "UTF-8"))),
    "crc32_castagnoli": ((STR,), INT, lambda s: crc32c_udf()(s)),
    "strlen": ((STR,), INT, lambda s: F.char_length(s).cast("long")),
    "cat": ((STR, STR), STR, lambda a, b: F.concat(a, b)),
    "substr": ((STR, INT, INT), STR, substr),
    "contains": ((STR, STR), INT, lambda a, b: truth(F.contains(a, b))),
    "str_prefix": ((STR, STR), INT, lambda a, b: truth(F.startswith(a, b))),
    "str_suffix": ((STR, STR), INT, lambda a, b: truth(F.endswith(a, b))),
    "str_ord": ((STR,), INT, lambda s: F.when(s == "", F.lit(-1)).otherwise(F.ascii(s)).cast("long")),
    "to_upper": ((STR,), STR, lambda s: F.translate(s, LOWER, UPPER)),
    "to_lower": ((STR,), STR, lambda s: F.translate(s, UPPER, LOWER)),
    "str_replace": ((STR, STR, STR), STR, lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b))),
    "trim": ((STR,), STR, lambda s: F.btrim(s, F.lit(" \t\n\x0b\x0c\r"))),
    "to_string": ((INT,), STR, lambda n: n.cast("string")),
    "to_number": ((STR,), INT, to_number),
}


def register(name: str, kinds: tuple[str, ...], result: str, fn: Callable[..., Column]) -> None:
    """A function of one's own: columns in, a column out."""
    TABLE[name] = (kinds, result, fn)


def compile_expr(e, env: dict[str, Value]) -> Value:
    match e:
        case Var(n):
            if n not in env:
                raise ProgramError(f"{n} has no value")
            return env[n]
        case Const(v):
            return Value(F.lit(v), STR) if isinstance(v, str) else Value(F.lit(v).cast("long"), INT)
        case Op(op, a, b):
            a, b = compile_expr(a, env), compile_expr(b, env)
            if a.kind != INT or b.kind != INT:
                raise ProgramError(f"{op} takes integers")
            x, y = a.col, b.col
            return Value({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: div(x, y), "%": lambda: mod(x, y)}[op](), INT)
        case Call("hash", (x,)):
            v = compile_expr(x, env)
            return Value(xxh3_int64(v.col) if v.kind == INT else F.xxhash64(v.col), INT)
        case Call("hmac_sha256", (x, Const(k))):
            v = compile_expr(x, env)
            if v.kind not in (INT, STR):
                raise ProgramError(f"argument 1 of hmac_sha256 is of kind {v.kind}")
            return Value(hmac_sha256(v.col.cast("string"), str(k)), STR)
        case Call(fn, args):
            if fn not in TABLE:
                raise ProgramError(f"no function {fn}")
            kinds, result, make = TABLE[fn]
            values = [compile_expr(a, env) for a in args]
            for k, (want, got) in enumerate(zip(kinds, values), 1):
                if want not in ("*", got.kind) or got.kind not in (INT, STR):
                    raise ProgramError(f"argument {k} of {fn} is of kind {got.kind}, not {want}")
            return Value(make(*(v.col for v in values)), result)
    raise ProgramError(f"{e} isn't an expression")


COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def compile_comparison(c, env: dict[str, Value]) -> Column:
    a, b = compile_expr(c.left, env), compile_expr(c.right, env)
    if a.kind != b.kind:
        raise ProgramError(f"{c.op} compares {a.kind} and {b.kind}")
    return COMPARE[c.op](a.col, b.col)
