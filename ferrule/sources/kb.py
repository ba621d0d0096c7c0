"""Knowledge base: API rules, profiles, constraints, policies and wrapper contracts, from files or from the built-in dimension."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RULE_SCHEMA = "api_id string, lang string, symbol string, profile_id string, bits_arg int, bits_unit string, arg_kind string, category string, ord int"
PROFILE_SCHEMA = "profile_id string, family string, quantum_secure string, q_security_bits int, reason string, recommendation string"
CONSTRAINT_SCHEMA = "profile_id string, mode string, param string, min_bits long, has_min boolean, forbidden array<long>, severity string, severity_map map<string,string>, recommended array<string>, reason string, migrate_to array<string>"

# Built-in API rules (language, symbol, profile, index of the size argument or -1, its unit, what the argument is, category).
RULES = [
    ("python", "RSA.generate", "ALG.RSA.PKE", 0, "bits", "size", "keygen"),
    ("python", "rsa.generate_private_key", "ALG.RSA.PKE", 1, "bits", "size", "keygen"),
    ("python", "DSA.generate", "ALG.DSA.SIG", 0, "bits", "size", "keygen"),
    ("python", "AES.new", "ALG.AES", 0, "bytes", "key", "cipher"),
    ("python", "DES.new", "ALG.DES", 0, "bytes", "key", "cipher"),
    ("python", "DES3.new", "ALG.3DES", 0, "bytes", "key", "cipher"),
    ("python", "hashlib.md5", "ALG.MD5", -1, "bits", "none", "hash"),
    ("python", "hashlib.sha1", "ALG.SHA1", -1, "bits", "none", "hash"),
    ("python", "ec.generate_private_key", "ALG.EC", 0, "bits", "curve", "keygen"),
    ("python", "os.urandom", "UTIL.RNG", 0, "bytes", "size", "random"),
    ("c", "RSA_generate_key_ex", "ALG.RSA.PKE", 1, "bits", "size", "keygen"),
    ("c", "EVP_aes_128_cbc", "ALG.AES", -1, "bits", "name", "cipher"),
    ("c", "EVP_aes_256_gcm", "ALG.AES", -1, "bits", "name", "cipher"),
    ("c", "EVP_des_ede3_cbc", "ALG.3DES", -1, "bits", "name", "cipher"),
    ("c", "AES_set_encrypt_key", "ALG.AES", 1, "bits", "size", "cipher"),
    ("c", "MD5_Init", "ALG.MD5", -1, "bits", "none", "hash"),
    ("c", "RAND_bytes", "UTIL.RNG", 1, "bytes", "size", "random"),
    ("java", "KeyGenerator.getInstance", "ALG.DYNAMIC", 0, "bits", "transformation", "factory"),
    ("java", "KeyPairGenerator.getInstance", "ALG.DYNAMIC", 0, "bits", "transformation", "factory"),
    ("java", "Cipher.getInstance", "ALG.DYNAMIC", 0, "bits", "transformation", "factory"),
    ("java", "MessageDigest.getInstance", "ALG.DYNAMIC", 0, "bits", "transformation", "hash"),
    ("go", "rsa.GenerateKey", "ALG.RSA.PKE", 1, "bits", "size", "keygen"),
    ("go", "aes.NewCipher", "ALG.AES", 0, "bytes", "key", "cipher"),
    ("go", "des.NewTripleDESCipher", "ALG.3DES", 0, "bytes", "key", "cipher"),
    ("go", "md5.New", "ALG.MD5", -1, "bits", "none", "hash"),
    ("go", "rand.Read", "UTIL.RNG", 0, "bytes", "key", "random"),
]
# What a file must import for a built-in rule, by language and the rule's first word; without an entry nothing.
RULE_IMPORTS = {
    ("python", "RSA"): ["Crypto", "Cryptodome"], ("python", "DSA"): ["Crypto", "Cryptodome"], ("python", "AES"): ["Crypto", "Cryptodome"], ("python", "DES"): ["Crypto", "Cryptodome"], ("python", "DES3"): ["Crypto", "Cryptodome"],
    ("python", "rsa"): ["cryptography"], ("python", "ec"): ["cryptography"], ("python", "hashlib"): ["hashlib"], ("python", "os"): ["os"],
    ("java", "KeyGenerator"): ["javax.crypto"], ("java", "Cipher"): ["javax.crypto"], ("java", "KeyPairGenerator"): ["java.security"], ("java", "MessageDigest"): ["java.security"],
    ("go", "rsa"): ["crypto/rsa"], ("go", "aes"): ["crypto/aes"], ("go", "des"): ["crypto/des"], ("go", "md5"): ["crypto/md5"], ("go", "rand"): ["crypto/rand"],
}
# Built-in profiles (id, family, quantum security, its bits, reason, recommendation).
PROFILES = [
    ("ALG.RSA", "RSA", "broken", 0, "factored by Shor's algorithm", "ML-KEM or ML-DSA"),
    ("ALG.RSA.PKE", "RSA", "broken", 0, "factored by Shor's algorithm", "ML-KEM"),
    ("ALG.RSA.SIG", "RSA", "broken", 0, "factored by Shor's algorithm", "ML-DSA"),
    ("ALG.DSA.SIG", "DSA", "broken", 0, "discrete logarithm by Shor's algorithm", "ML-DSA"),
    ("ALG.EC", "EC", "broken", 0, "discrete logarithm by Shor's algorithm", "ML-KEM"),
    ("ALG.AES", "AES", "weak", 64, "key search halved by Grover's algorithm", "256-bit keys"),
    ("ALG.DES", "DES", "broken", 28, "56-bit key", "AES-256"),
    ("ALG.3DES", "3DES", "weak", 56, "64-bit block", "AES-256"),
    ("ALG.RC4", "RC4", "broken", 0, "biased key stream", "AES-256"),
    ("ALG.MD5", "MD5", "broken", 0, "collisions", "SHA-256"),
    ("ALG.SHA1", "SHA1", "broken", 0, "collisions", "SHA-256"),
    ("ALG.SHA256", "SHA256", "strong", 128, "", ""),
]
# Built-in constraints, in the order of CONSTRAINT_SCHEMA.
CONSTRAINTS = [
    ("ALG.RSA.PKE", "quantum", "key_bits", None, False, [], "critical", {}, [], "no resistant size", ["ML-KEM"]),
    ("ALG.RSA.PKE", "classic", "key_bits", None, True, [512, 768, 1024], "error", {"2048": "info"}, [], "short modulus", []),
    ("ALG.DSA.SIG", "quantum", "key_bits", None, False, [], "critical", {}, [], "no resistant size", ["ML-DSA"]),
    ("ALG.EC", "quantum", "key_bits", None, False, [], "critical", {}, [], "no resistant size", ["ML-KEM", "ML-DSA"]),
    ("ALG.AES", "quantum", "key_bits", 256, True, [], None, {"128": "warning", "192": "info", "256": "none"}, [], "halved by search", []),
    ("ALG.AES", "classic", "mode", None, True, [], None, {"ECB": "error"}, [], "blocks show", []),
    ("ALG.DES", "classic", "algorithm", None, True, [], "critical", {}, [], "56-bit key", ["AES-256"]),
    ("ALG.3DES", "classic", "algorithm", None, True, [], "warning", {}, [], "64-bit block", ["AES-256"]),
    ("ALG.MD5", "classic", "algorithm", None, True, [], "error", {}, [], "collisions", ["SHA-256"]),
    ("ALG.SHA1", "classic", "algorithm", None, True, [], "error", {}, [], "collisions", ["SHA-256"]),
    ("ALG.RC4", "classic", "algorithm", None, True, [], "critical", {}, [], "biased key stream", ["AES-256"]),
]


def builtin(spark: SparkSession) -> dict[str, DataFrame]:
    """The dimensions that ship with the library; tens of rows."""
    rules = [(f"{r[0]}.{r[1]}", *r, i, RULE_IMPORTS.get((r[0], r[1].split(".")[0]), [])) for i, r in enumerate(RULES)]
    return {"rules": spark.createDataFrame(rules, RULE_SCHEMA + ", imports array<string>"), "profiles": spark.createDataFrame(PROFILES, PROFILE_SCHEMA), "constraints": spark.createDataFrame(CONSTRAINTS, CONSTRAINT_SCHEMA)}


def strip_comments(text: str) -> str:
    """JSON text without // and /* */ comments; slashes in strings stay."""
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)


def load_mappings(spark: SparkSession, glob: str, lang: str) -> DataFrame:
    """rules of API-mapping JSON files, {"mappings": [{api_id, function, imports, func_params, semantic: {profile_id, operation, key: {index, unit}}}]}.
    First file and entry in order win for one function; missing fields are filled from later ones."""
    schema = "mappings array<struct<api_id string, function string, imports array<string>, func_params array<string>, semantic struct<profile_id string, operation string, key struct<param string, index int, unit string, bits int>>>>"
    raw = spark.read.option("multiLine", True).option("allowComments", True).schema(schema).json(glob)
    rows = raw.select(F.input_file_name().alias("f"), F.posexplode("mappings").alias("i", "m"))
    at = F.struct("f", "i")
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    named = F.when(F.array_position("m.func_params", F.col("m.semantic.key.param")) > 0, F.array_position("m.func_params", F.col("m.semantic.key.param")).cast("int") - 1)
    index = F.coalesce("m.semantic.key.index", named)
    flat = rows.select("f", "i", F.col("m.api_id").alias("api_id"), F.col("m.function").alias("symbol"), F.col("m.semantic.profile_id").alias("profile_id"), index.alias("bits_arg"), F.col("m.semantic.key.unit").alias("bits_unit"), F.col("m.semantic.operation").alias("category"))
    merged = flat.groupBy("symbol").agg(F.min(at).alias("__at"), *[pick(c).alias(c) for c in ("api_id", "profile_id", "bits_arg", "bits_unit", "category")])
    ordered = merged.withColumn("ord", F.row_number().over(Window.orderBy("__at")))
    return ordered.select("api_id", F.lit(lang).alias("lang"), "symbol", F.coalesce("profile_id", F.lit("ALG.DYNAMIC")).alias("profile_id"), F.coalesce("bits_arg", F.lit(-1)).alias("bits_arg"), F.coalesce("bits_unit", F.lit("bits")).alias("bits_unit"), F.when(F.col("bits_arg") >= 0, "size").otherwise("none").alias("arg_kind"), "category", "ord")


def load_policy(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """(params, whitelist) of a policy text, YAML or JSON."""
    try:
        data = json.loads(strip_comments(text))
    except json.JSONDecodeError:
        import yaml

        data = yaml.safe_load(text)
    policy = data.get("org_policy", data)
    rows = [(key, param, [str(x) for x in spec.get("allow", [])], [str(x) for x in spec.get("disallow", [])], spec.get("severity_if_not_allow") or spec.get("severity_if_disallow")) for key, params in (policy.get("enforce_params") or {}).items() for param, spec in params.items()]
    free = [(x,) for x in (policy.get("transitional_whitelist") or {}).get("algorithms", [])]
    return spark.createDataFrame(rows, "key string, param string, allow array<string>, disallow array<string>, severity string"), spark.createDataFrame(free, "key string")


def load_wrappers(spark: SparkSession, manual: str | None, auto: str | None) -> DataFrame:
    """Wrapper contracts (api_id, lang, symbol, profile_id, source) of two folders of JSON files; manual ones win for one api_id."""
    schema = "api_id string, language string, function string, semantic struct<profile_id string>, derived_meta struct<source string, confidence string>"
    parts = [spark.read.option("multiLine", True).schema(schema).json(p).withColumn("source", F.lit(s)).withColumn("__o", F.lit(o)) for o, (s, p) in enumerate((("manual", manual), ("auto", auto))) if p]
    if not parts:
        return spark.createDataFrame([], "api_id string, lang string, symbol string, profile_id string, source string")
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    best = rows.groupBy("api_id").agg(F.min_by(F.struct("language", "function", "semantic", "source"), "__o").alias("x"))
    return best.select("api_id", F.col("x.language").alias("lang"), F.col("x.function").alias("symbol"), F.col("x.semantic.profile_id").alias("profile_id"), "x.source")
