"""Algorithms, modes and profiles from names and transformation strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Profiles of algorithm names.
PROFILES = {
    "AES": "ALG.AES", "DES": "ALG.DES", "IDEA": "ALG.IDEA", "BLOWFISH": "ALG.BLOWFISH", "DES3": "ALG.3DES", "DESEDE": "ALG.3DES",
    "TRIPLEDES": "ALG.3DES", "3DES": "ALG.3DES", "RSA": "ALG.RSA", "DSA": "ALG.DSA", "DH": "ALG.DH", "DIFFIEHELLMAN": "ALG.DH",
    "ECDSA": "ALG.ECDSA", "ECDH": "ALG.ECDH", "EC": "ALG.EC", "ECC": "ALG.EC", "RC4": "ALG.RC4", "RC2": "ALG.RC2",
    "MD2": "ALG.MD2", "MD4": "ALG.MD4", "CHACHA20": "ALG.CHACHA20", "CHACHA20-POLY1305": "ALG.CHACHA20_POLY1305",
    "MD5": "ALG.MD5", "SHA1": "ALG.SHA1", "SHA-1": "ALG.SHA1", "SHA224": "ALG.SHA224", "SHA-224": "ALG.SHA224",
    "SHA256": "ALG.SHA256", "SHA-256": "ALG.SHA256", "SHA384": "ALG.SHA384", "SHA-384": "ALG.SHA384", "SHA512": "ALG.SHA512",
    "SHA-512": "ALG.SHA512",
}
# Fixed values: (profile, pattern of the function's name, narrower profile), first match wins.
PUBLIC_KEY_KINDS = [
    ("ALG.RSA", "encrypt|decrypt", "ALG.RSA.PKE"), ("ALG.RSA", "sign|verify", "ALG.RSA.SIG"), ("ALG.RSA", "generate", "ALG.RSA.PKE"),
    ("ALG.DSA", "sign|verify|generate", "ALG.DSA.SIG"), ("ALG.ECDSA", "sign|verify|generate", "ALG.ECDSA.SIG"),
    ("ALG.EDDSA", "sign|verify|generate", "ALG.EDDSA.SIG"), ("ALG.ED25519", "sign|verify|generate", "ALG.ED25519.SIG"),
    ("ALG.ECDH", "generate|newprivatekey|ecdh", "ALG.ECDH"), ("ALG.DH", "generate|computekey", "ALG.DH"),
    ("ALG.ELGAMAL", "encrypt|decrypt", "ALG.ELGAMAL.PKE"), ("ALG.ELGAMAL", "sign|verify", "ALG.ELGAMAL.SIG"),
]
# Block-cipher modes in the order they are looked for in a text.
MODE_TOKENS = ["ECB", "GCM", "CTR", "CBC", "CFB", "OFB"]
# Families in the order they are looked for in an API name (a longer one before one inside it).
NAME_FAMILIES = ["CHACHA20", "CAMELLIA", "BLOWFISH", "ED25519", "X25519", "ECDSA", "ECDH", "EDDSA", "3DES", "DESEDE", "ARIA", "AES", "DES", "RSA", "DSA", "SM2", "SM3", "SM4", "SHA3", "SHA512", "SHA384", "SHA256", "SHA224", "SHA1", "MD5", "MD4", "RC4", "HMAC", "PBKDF2", "DH"]
# Profile families of factories and of operations.
FACTORY_WORDS = ["GENERATE", "NEW", "CREATE", "INSTANCE", "KEYGEN", "INIT"]


def profile_of_name(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PROFILES.items() for x in pair]), F.upper(F.trim(name)))


def classify_public_key(profile: Column, function: Column) -> Column:
    f = F.lower(function)
    return F.coalesce(*[F.when((profile == p) & f.rlike(pattern), F.lit(to)) for p, pattern, to in PUBLIC_KEY_KINDS], profile)


def mode_of(text: Column) -> Column:
    t = F.upper(text)
    return F.coalesce(*[F.when(t.contains(m), F.lit(m)) for m in MODE_TOKENS])


def family_of_api(name: Column) -> Column:
    n = F.upper(F.replace(name, F.lit("_"), F.lit("")))
    return F.coalesce(*[F.when(n.contains(x), F.lit(x)) for x in NAME_FAMILIES])


def is_factory(name: Column) -> Column:
    return F.upper(name).rlike("|".join(FACTORY_WORDS))


def transformation(text: Column) -> Column:
    """struct(algorithm, mode, padding) of "A/M/P", "A/M", "A/P" or "A", quotes and blanks aside."""
    parts = F.split(F.regexp_replace(F.trim(text), r"""^["']|["']$""", ""), "/")
    part = lambda i: F.nullif(F.trim(F.get(parts, i)), F.lit(""))
    two = F.size(parts) == 2
    is_mode = F.upper(part(1)).isin([m.upper() for m in [*MODE_TOKENS, "CCM", "XTS", "OCB", "NONE"]])
    return F.struct(F.upper(part(0)).alias("algorithm"), F.when(~two | is_mode, F.upper(part(1))).alias("mode"), F.when(two & ~is_mode, part(1)).otherwise(part(2)).alias("padding"))


def transformation_profile(text: Column) -> Column:
    return profile_of_name(transformation(text).algorithm)
