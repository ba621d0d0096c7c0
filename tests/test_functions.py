"""Column functions against the cases that their definitions state."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrule.functions import algorithms, bits, expressions, levels, linear, names


def values(spark, column, items, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "function,cases",
    [
        (bits.digest_bits, {"SHA256": 256, "sha-512": 512, "MD5": 128, "hashlib.sha1": 160, "": None, None: None, "zzz9q": None}),
        (bits.cipher_bits, {"AES-128-CBC": 128, "des-ede3": 168, "ChaCha20": 256, "EVP_aes_192_gcm": 192}),
        (bits.curve_bits, {"secp256r1": 256, "P-384": 384, "X25519": 256, "NID_secp521r1": 521}),
        (bits.api_name_bits, {"EVP_aes_128_cbc": 128, "HMAC_SHA256": 256, "EVP_des_ede3_cbc": 168, "EVP_des_ede_cbc": 112, "DES_set_key": 56, "set_key_length_256": 256}),
        (bits.safe_int, {"256": 256, "16 * 2": 32, "128 / 8": 16, "7 / 2": None, "0x100": None, "a+1": None, "": None}),
        (bits.secp_bits, {"SECP256R1": 256, "secp_384": 384, "secp999": None}),
        (bits.expression_bits, {"make([]byte, 16)": 128, "b'0123456789abcdef'": 128, "new byte[32]": 256, "bytearray(24)": 192, "EVP_aes_256_gcm()": 256, "x": None}),
        (names.function_tail, {"a::b.c": "c", "ns::f [init]": "f", "plain": "plain"}),
        (names.family, {"ALG.RSA.PKE": "RSA", "ALG.AES-128": "AES", "UTIL.UNKNOWN": None}),
        (algorithms.transformation_profile, {"AES": "ALG.AES", "AES/CBC/PKCS5Padding": "ALG.AES", "DESede/CBC/PKCS5Padding": "ALG.3DES", '"RSA/ECB/OAEPPadding"': "ALG.RSA", "nope": None}),
        (algorithms.family_of_api, {"ECDSA_do_sign": "ECDSA", "DSA_sign": "DSA", "aes_encrypt": "AES"}),
        (expressions.evaluate, {"2 + 3 * 4": 14, "(2 + 3) * 4": 20, "15 / 3": 5, "10 % 3": 1, "2 ** 3": 8, "x + 1": None, "7": 7, "8 - 3 - 2": 3, "(1)*(2)": 2}),
    ],
)
def test_tables(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_symbolic():
    assert expressions.evaluate_text("x + y", {"x": 10, "y": 5}) == 15
    assert expressions.evaluate_text("x + 1") == "(x + 1)"
    assert expressions.evaluate_text("3 < 2") is False
    assert expressions.evaluate_text("strlen(\"abcd\") * 8") == 32
    assert expressions.evaluate_text("0x10") == 16
    assert expressions.evaluate_text("1 +") is None
    assert expressions.variables("strlen(name) + 10") == {"name"}


def test_binding(spark):
    got = values(spark, linear.binding, ["256", "keylen", "keylen*8", "8*keylen", "keylen+10", "size-5", "bits/8", "f(x)"])
    assert [(b.kind, b.source, b.mul, b.div, b.add, b.value) for b in got] == [("constant", None, 1, 1, 0, 256), ("variable", "keylen", 1, 1, 0, None), ("linear", "keylen", 8, 1, 0, None), ("linear", "keylen", 8, 1, 0, None), ("linear", "keylen", 1, 1, 10, None), ("linear", "size", 1, 1, -5, None), ("linear", "bits", 1, 8, 0, None), ("complex", None, 1, 1, 0, None)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 500), st.integers(1, 16), st.integers(-20, 20), st.integers(1, 8))
def test_bounds_are_tight(spark, t, mul, add, div):
    row = spark.range(1).select(linear.at_least(F.lit(t), F.lit(mul), F.lit(add), F.lit(div)), linear.at_most(F.lit(t), F.lit(mul), F.lit(add), F.lit(div))).first()
    f = lambda x: x * mul // div + add
    assert f(row[0]) >= t > f(row[0] - 1)
    assert f(row[1]) <= t < f(row[1] + 1)


def test_levels(spark):
    r = spark.range(1).select(
        levels.worst(F.lit("low"), F.lit("critical"), F.lit(None).cast("string")),
        levels.of_rule(F.lit(False), F.lit("weak"), F.lit(False)),
        levels.of_rule(F.lit(True), F.lit("strong"), F.lit(True)),
        *[levels.in_range(F.lit(v), F.lit(s)) for v, s in ((1024, "< 2048"), (2048, "2048"), (4096, ">= 4096"), (5, "x"))],
    ).first()
    assert tuple(r) == ("critical", "medium", "high", True, True, True, False)


def test_top_level_split(spark):
    assert values(spark, names.top_level_split, ["a, f(b, c), [1,2]", "", "'x,y', z"]) == [["a", "f(b, c)", "[1,2]"], [], ["'x,y'", "z"]]


def test_suffix(spark):
    df = spark.createDataFrame([("a.b.c", "b.c"), ("c", "a.c"), ("a.bc", "c"), ("x", "x")], "a string, b string")
    assert [r[0] for r in df.select(names.suffix_equal(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]
