import hashlib
import hmac
import uuid
import zlib

import pytest

from rulespan.engine import Engine


def one(spark, expr, *args):
    names = "abc"[: len(args)]
    cols = ", ".join(f"{n}: {'string' if isinstance(a, str) else 'int64'}" for n, a in zip(names, args))
    df = spark.createDataFrame([tuple(args)], ", ".join(f"{n} {'string' if isinstance(a, str) else 'long'}" for n, a in zip(names, args)))
    return Engine(spark, f".decl e({cols})\nt({expr}) :- e({', '.join(names)}).", {"e": df}).relation("t").collect()[0][0]


BIG = (1 << 63) - 1
CASES = [
    ("a + b", (BIG, 1), -BIG - 1), ("a * b", (BIG, 2), -2), ("a / b", (-7, 2), -3), ("a / b", (7, 0), 0), ("a % b", (-7, 3), -1), ("a % b", (7, 0), 0),
    ("band(a, b)", (12, 10), 8), ("bor(a, b)", (12, 10), 14), ("bxor(a, b)", (12, 10), 6), ("bnot(a)", (5,), -6), ("bshl(a, b)", (3, 4), 48), ("bshr(a, b)", (-16, 2), -4),
    ("hash(a)", (1,), 3439722301264460078), ("hash(a)", (2,), 2343778756980564547), ("hash(a)", (3,), 5589565451239960189), ("hash(a)", (5,), -8213464378072455284),
    ("strlen(a)", ("héé😀",), 4), ("cat(a, b)", ("x", "y"), "xy"), ("substr(a, b, c)", ("hello", 1, 3), "ell"), ("substr(a, b, c)", ("héllo", 5, 2), ""), ("substr(a, b, c)", ("hello", 6, 1), ""),
    ("substr(a, b, c)", ("hello", -1, 1), ""), ("substr(a, b, c)", ("hello", 2, 99), "llo"), ("contains(a, b)", ("abc", ""), 1), ("contains(a, b)", ("abc", "d"), 0), ("str_prefix(a, b)", ("abc", "ab"), 1),
    ("str_suffix(a, b)", ("abc", "ab"), 0), ("str_ord(a)", ("😀x",), 128512), ("str_ord(a)", ("",), -1), ("str_ord(to_string(a))", (65,), 54), ("to_upper(a)", ("aéz",), "AéZ"), ("to_lower(a)", ("AÉZ",), "aÉz"),
    ("str_replace(a, b, c)", ("aaa", "aa", "b"), "ba"), ("str_replace(a, b, c)", ("aaa", "", "b"), "aaa"), ("trim(a)", ("\t x \x0b\r\n",), "x"), ("to_string(a)", (-5,), "-5"),
    ("to_number(a)", ("12ab",), 12), ("to_number(a)", ("  -7",), -7), ("to_number(a)", ("x",), 0), ("to_number(a)", ("99999999999999999999",), BIG), ("to_number(a)", ("-99999999999999999999",), -BIG - 1),
    ("crc32_ethernet(a)", ("123456789",), 0xCBF43926), ("crc32_castagnoli(a)", ("123456789",), 0xE3069283), ("md5(a)", ("é",), hashlib.md5("é".encode()).hexdigest()), ("sha1(a)", (12,), hashlib.sha1(b"12").hexdigest()),
    ("sha256(a)", ("x",), hashlib.sha256(b"x").hexdigest()), ("sha512(a)", ("x",), hashlib.sha512(b"x").hexdigest()), ("hmac_sha256(a, b)", ("m", "k"), hmac.new(b"k", b"m", "sha256").hexdigest()),
    ("uuid5(a, b)", (str(uuid.NAMESPACE_URL), "x"), str(uuid.uuid5(uuid.NAMESPACE_URL, "x"))), ("crc32_ethernet(a)", ("é",), zlib.crc32("é".encode())),
]


@pytest.mark.parametrize("expr, args, want", CASES)
def test_scalar(spark, expr, args, want):
    assert one(spark, expr, *args) == want


def test_uuid4(spark):
    r = Engine(spark, "e(1). e(2).\nt(x, uuid4()) :- e(x).").relation("t").collect()
    assert len({x[1] for x in r}) == 2 and all(len(x[1]) == 36 for x in r)


def test_string_order_is_by_code(spark):
    r = Engine(spark, 'e("b"). e("a"). e("é").\nt(x, y) :- e(x), e(y), x < y.').relation("t").collect()
    assert {tuple(x) for x in r} == {("a", "b"), ("a", "é"), ("b", "é")}
