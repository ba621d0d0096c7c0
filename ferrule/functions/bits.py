"""Key, digest and curve sizes from names, as built-in expressions over fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digest sizes in bits.
DIGEST_BITS = {
    "sha1": 160, "sha-1": 160, "sha224": 224, "sha-224": 224, "sha256": 256, "sha-256": 256, "sha384": 384, "sha-384": 384,
    "sha512": 512, "sha-512": 512, "sha512-224": 224, "sha512-256": 256, "sha3-224": 224, "sha3-256": 256, "sha3-384": 384,
    "sha3-512": 512, "sha3_224": 224, "sha3_256": 256, "sha3_384": 384, "sha3_512": 512, "shake128": 128, "shake256": 256,
    "md5": 128, "md4": 128, "md2": 128, "ripemd160": 160, "ripemd-160": 160, "sm3": 256, "blake2b": 512, "blake2s": 256,
    "blake2b-512": 512, "blake2s-256": 256, "whirlpool": 512,
}
# Cipher key sizes in bits.
CIPHER_BITS = {
    "aes-128": 128, "aes-192": 192, "aes-256": 256, "aes128": 128, "aes192": 192, "aes256": 256, "des": 56, "des-ecb": 56,
    "des-cbc": 56, "des-cfb": 56, "des-ofb": 56, "des-ede": 112, "des-ede3": 168, "des3": 168, "3des": 168, "tripledes": 168,
    "idea": 128, "idea-128": 128, "aria-128": 128, "aria-192": 192, "aria-256": 256, "aria128": 128, "aria192": 192,
    "aria256": 256, "camellia-128": 128, "camellia-192": 192, "camellia-256": 256, "camellia128": 128, "camellia192": 192,
    "camellia256": 256, "chacha20": 256, "chacha20-poly1305": 256, "salsa20": 256, "sm4": 128, "sm1": 128, "rc4": 128,
    "rc2": 128, "rc5": 128, "blowfish": 128, "bf": 128, "cast5": 128, "cast-128": 128, "seed": 128,
}
# Curve sizes in bits.
CURVE_BITS = {
    "p-192": 192, "p-224": 224, "p-256": 256, "p-384": 384, "p-521": 521, "p192": 192, "p224": 224, "p256": 256, "p384": 384,
    "p521": 521, "secp192r1": 192, "secp224r1": 224, "secp256r1": 256, "secp384r1": 384, "secp521r1": 521, "secp256k1": 256,
    "prime192v1": 192, "prime256v1": 256, "x9_62_prime192v1": 192, "x9_62_prime256v1": 256, "sect163k1": 163,
    "sect233k1": 233, "sect283k1": 283, "sect409k1": 409, "sect571k1": 571, "brainpoolp256r1": 256, "brainpoolp384r1": 384,
    "brainpoolp512r1": 512, "curve25519": 256, "x25519": 256, "ed25519": 256, "curve448": 448, "x448": 448, "ed448": 448,
    "sm2": 256, "sm2p256v1": 256,
}
# Other named sizes, common asymmetric sizes, and sizes that a bare number in a name may mean.
OTHER_BITS = {"dsa-1024": 1024, "dsa-2048": 2048, "dsa-3072": 3072, "dh-1024": 1024, "dh-2048": 2048, "dh-3072": 3072, "dh-4096": 4096}
ASYMMETRIC_BITS = [512, 1024, 2048, 3072, 4096, 7680, 8192, 15360]
NAMED_BITS = [56, 64, 112, 128, 160, 168, 192, 224, 256, 384, 448, 512, 521, 1024, 2048, 3072, 4096]
MODES = ["ecb", "cbc", "cfb", "ofb", "ctr", "gcm", "ccm", "ocb", "xts", "wrap"]
#: Every size that a finding may carry.
VALID_BITS = sorted({*DIGEST_BITS.values(), *CIPHER_BITS.values(), *CURVE_BITS.values(), *OTHER_BITS.values(), *ASYMMETRIC_BITS})


def _exact(table: dict[str, int], name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)


def _first(table: dict[str, int], test) -> Column:
    """Bits of the first entry, in the table's order, for which test(key) holds."""
    entries = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in table.items()])
    return F.get(F.filter(entries, lambda e: test(e.k)), 0).v


def _stripped(name: Column, prefixes: list[str]) -> Column:
    return F.regexp_replace(name, "^(?:" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")", "")


def _known(name: Column) -> Column:
    return F.lower(F.trim(name))


def digest_bits(name: Column) -> Column:
    """Exact name, then without a library prefix, then the first table name that contains it or is contained."""
    n = _known(name)
    return F.when(n != "", F.coalesce(_exact(DIGEST_BITS, n), _exact(DIGEST_BITS, _stripped(n, ["evp_", "openssl_", "hashlib."])), _first(DIGEST_BITS, lambda k: n.contains(k) | k.contains(n))))


def cipher_bits(name: Column) -> Column:
    """A three-digit number between separators, then the name without its mode, then the first table name in it."""
    n = _stripped(_known(name), ["evp_", "openssl_", "cipher."])
    number = F.try_to_number(F.nullif(F.regexp_extract(n, r"[-_](\d{3})[-_]", 1), F.lit("")), F.lit("999")).cast("int")
    bare = F.regexp_replace(n, r"[-_](" + "|".join(MODES) + ").*$", "")
    return F.when(n != "", F.coalesce(number, _exact(CIPHER_BITS, bare), _first(CIPHER_BITS, lambda k: bare.contains(k))))


def curve_bits(name: Column) -> Column:
    n = _known(name)
    return F.when(n != "", F.coalesce(_exact(CURVE_BITS, n), _exact(CURVE_BITS, _stripped(n, ["nid_", "openssl_", "ec."])), _first(CURVE_BITS, lambda k: n.contains(k) | k.contains(n))))


def algorithm_bits(name: Column, kind: str | None = None) -> Column:
    """By kind (hash, cipher, ec); without one: cipher, then curve, then digest, then other names."""
    if kind:
        return {"hash": digest_bits, "cipher": cipher_bits, "symmetric": cipher_bits, "ec": curve_bits, "curve": curve_bits, "ecc": curve_bits}[kind.lower()](name)
    return F.coalesce(cipher_bits(name), curve_bits(name), digest_bits(name), _exact(OTHER_BITS, _known(name)))


def api_name_bits(name: Column) -> Column:
    """DES variants first, then the name without a library prefix, then its first plausible number."""
    n = F.lower(name)
    number = F.nullif(F.regexp_extract(name, r"[-_]?(\d{2,4})[-_]?", 1), F.lit("")).cast("int")
    return (
        F.when(n.rlike("des_ede3|des3|3des"), 168)
        .when(n.contains("des_ede"), 112)
        .when(n.contains("des_"), 56)
        .otherwise(F.coalesce(algorithm_bits(_stripped(n, ["evp_", "openssl_", "hmac_", "pbkdf2_", "ec_", "rsa_", "dsa_"])), F.when(number.isin(NAMED_BITS), number)))
    )


def secp_bits(name: Column) -> Column:
    """Up to four digits after SECP, if they are a valid size."""
    n = F.nullif(F.regexp_extract(F.upper(name), r"SECP\D*(\d{1,4})", 1), F.lit("")).cast("int")
    return F.when(n.isin(VALID_BITS), n)


def is_valid_bits(bits: Column) -> Column:
    return bits.isin(VALID_BITS)


def bytes_or_bits(value: Column) -> Column:
    """Sizes up to 64 are byte counts."""
    return F.when(value <= 64, value * 8).otherwise(value)


def looks_like_bits(value: Column, name: Column) -> Column:
    """A valid size, or any from 128 to 16384 if the name speaks of bits or a size."""
    return value.isin(VALID_BITS) | (value.between(128, 16384) & F.lower(F.coalesce(name, F.lit(""))).rlike("bit|size|len|modulus"))


def looks_like_bytes(value: Column, name: Column) -> Column:
    return value.isin(16, 24, 32, 48, 64) & F.lower(F.coalesce(name, F.lit(""))).rlike("byte|len|size|key")


def expression_bits(code: Column) -> Column:
    """Bits of an allocation or literal: make([]byte, N), new byte[N], bytearray(N), b'..', '..'.getBytes(), a sized cipher name."""
    part = lambda pattern: F.nullif(F.regexp_extract(code, pattern, 1), F.lit(""))
    size = F.coalesce(part(r"make\(\s*\[\]byte\s*,\s*(\d{1,6})"), part(r"new\s+byte\s*\[\s*(\d{1,6})\s*\]"), part(r"(?:bytearray|bytes|urandom|token_bytes|get_random_bytes)\(\s*(\d{1,6})\s*\)"), part(r"\[(\d{1,6})\]byte")).cast("int")
    literal = F.coalesce(part(r"^\s*b'([^'\\]*)'"), part(r'^\s*b"([^"\\]*)"'), part(r'^\s*"([^"\\]*)"\.getBytes\('), part(r'\[\]byte\("([^"\\]*)"\)'))
    return F.coalesce(size * 8, F.octet_length(literal) * 8, F.when(code.rlike(r"^EVP_"), api_name_bits(F.regexp_replace(code, r"\(.*$", ""))))


def safe_int(code: Column) -> Column:
    """A whole number, or one of + - * / over two; null for anything else (hexadecimal included). Division must come out even."""
    a = F.nullif(F.regexp_extract(code, r"^\s*(\d{1,9})\s*[-+*/]\s*\d{1,9}\s*$", 1), F.lit("")).cast("long")
    b = F.nullif(F.regexp_extract(code, r"^\s*\d{1,9}\s*[-+*/]\s*(\d{1,9})\s*$", 1), F.lit("")).cast("long")
    op = F.regexp_extract(code, r"^\s*\d{1,9}\s*([-+*/])\s*\d{1,9}\s*$", 1)
    alone = F.nullif(F.regexp_extract(code, r"^\s*(\d{1,18})\s*$", 1), F.lit("")).cast("long")
    return F.coalesce(alone, F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when((op == "/") & (b != 0) & (a % F.nullif(b, F.lit(0)) == 0), F.expr("1") * F.floor(F.try_divide(a, b)).cast("long")))
