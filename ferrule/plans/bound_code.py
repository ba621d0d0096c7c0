"""Operators over code facts, bound to the driver's tables. They add to the queries of `bound`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits, expressions, linear, names
from ..operators import code, state
from .bound import _profiles, long, query, read


def pick(index, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


@query("SELECT p_partkey, (p_size * 8 + p_partkey % 7)::BIGINT AS value FROM part WHERE p_size % 3 <> 2 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 3 = 2")
def q_evaluate_expression(spark, sf_dir):
    size, rest = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(size, F.lit(" * 8 + "), rest)).when(F.col("p_size") % 3 == 1, F.concat(rest, F.lit(" + ("), size, F.lit(") * 2 ** 3"))).otherwise(F.concat(size, F.lit(" * unknown")))
    return read(spark, sf_dir, "part").select("p_partkey", expressions.evaluate(text).alias("value"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN (16 * (1 + p_size % 3))::BIGINT WHEN 1 THEN (p_size + 2)::BIGINT WHEN 2 THEN CASE WHEN p_size % 8 = 0 THEN p_size // 8 END ELSE NULL END AS value FROM part""")
def q_safe_int(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("16 * "), (F.col("p_size") % 3 + 1).cast("string"))).when(F.col("p_size") % 4 == 1, F.concat(size, F.lit(" + 2"))).when(F.col("p_size") % 4 == 2, F.concat(size, F.lit(" / 8"))).otherwise(F.concat(F.lit("0x"), size))
    return read(spark, sf_dir, "part").select("p_partkey", bits.safe_int(text).alias("value"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'constant' WHEN 1 THEN 'variable' WHEN 2 THEN 'linear' ELSE 'complex' END AS kind, CASE p_size % 4 WHEN 1 THEN 'keylen' WHEN 2 THEN 'keylen' END AS source,
CASE WHEN p_size % 4 = 2 THEN p_size::BIGINT ELSE 1 END AS mul, CASE WHEN p_size % 4 = 0 THEN p_size::BIGINT END AS value FROM part""")
def q_bind_argument(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 4 == 0, size).when(F.col("p_size") % 4 == 1, F.lit("keylen")).when(F.col("p_size") % 4 == 2, F.concat(F.lit("keylen * "), size)).otherwise(F.concat(F.lit("f("), size, F.lit(")")))
    return read(spark, sf_dir, "part").select("p_partkey", linear.binding(text).alias("b")).select("p_partkey", "b.kind", "b.source", "b.mul", "b.value")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN true ELSE false END AS inherent FROM part WHERE p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size * 16 < 256)""")
def q_vulnerabilities(spark, sf_dir):
    profile = pick(F.col("p_size") % 3, "ALG.RSA.PKE", "ALG.AES", "ALG.MD5")
    rows = read(spark, sf_dir, "part").select("p_partkey", profile.alias("profile_id"), (long("p_size") * 16).alias("key_bits"))
    return code.vulnerabilities(rows, _profiles(spark).withColumn("migrate_to", F.array().cast("array<string>"))).select("p_partkey", "inherent")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size * 128 IN (1024, 2048, 3072, 4096) THEN p_size::BIGINT * 128 END
WHEN 1 THEN CASE WHEN p_size * 128 IN (256, 384, 512, 1024, 2048, 3072, 4096) THEN p_size::BIGINT * 128 END ELSE CASE WHEN p_size * 128 IN (128, 256, 384, 512, 1024, 2048, 3072, 4096) THEN p_size::BIGINT * 128 END END AS key_bits FROM part""")
def q_plausible_bits(spark, sf_dir):
    profile = pick(F.col("p_size") % 3, "ALG.RSA.PKE", "ALG.EC", "ALG.AES")
    rows = read(spark, sf_dir, "part").select("p_partkey", profile.alias("profile_id"), (long("p_size") * 128).alias("key_bits"))
    return code.plausible_bits(rows).select("p_partkey", "key_bits")


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'ALG.WRAP' WHEN 1 THEN 'ALG.AES' WHEN 2 THEN 'ALG.3DES' WHEN 3 THEN 'ALG.LIB' END AS profile_id, CASE s_suppkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 5 WHEN 3 THEN 6 END::BIGINT AS tier FROM supplier""")
def q_identify(spark, sf_dir):
    i = F.col("s_suppkey") % 5
    none = F.lit(None).cast("string")
    calls = read(spark, sf_dir, "supplier").select("s_suppkey", F.lit("call").alias("symbol"), F.when(i == 0, "ALG.WRAP").alias("wrapper_profile"), F.when(i == 1, "ALG.AES").when(i == 2, "UTIL.CIPHER").alias("api_profile"), none.alias("arg_state_profile"), none.alias("receiver_profile"), F.when(i == 2, "DESede/CBC/PKCS5Padding").alias("arg"), F.when(i == 3, "ALG.LIB").alias("library_profile"))
    own = spark.createDataFrame([("helper",)], "name string")
    return code.identify(calls, own).select("s_suppkey", "profile_id", long("tier").alias("tier"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'CONST' WHEN 1 THEN 'PARAM' WHEN 2 THEN 'STATE' ELSE 'UNKNOWN' END AS input_source FROM part""")
def q_key_input(spark, sf_dir):
    calls = read(spark, sf_dir, "part").select("p_partkey", F.lit("gen").alias("owner_function"), pick(F.col("p_size") % 4, "2048", "bits * 8", "self.size", "load(x)").alias("arg"))
    params = spark.createDataFrame([("gen", "bits"), ("other", "x")], "func string, param string")
    return code.key_input(calls, params).select("p_partkey", "input_source")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '(' || p_size || ') * 2' WHEN 1 THEN '(n) * 2' END AS inlined FROM part""")
def q_inline(spark, sf_dir):
    i = F.col("p_size") % 3
    calls = read(spark, sf_dir, "part").select("p_partkey", F.when(i == 2, "other").otherwise("twice").alias("symbol"), F.array(F.when(i == 0, F.col("p_size").cast("string")).otherwise(F.lit("n"))).alias("args"))
    functions = spark.createDataFrame([("twice", "x * 2", ["x"])], "name string, return_expression string, params array<string>")
    return code.inline_calls(calls, functions).select("p_partkey", "inlined")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1""")
def q_config_value(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    subs = e.select("event_id", F.col("event_id").alias("path"), F.when(F.col("event_id") % 2 == 0, "k").otherwise("missing").alias("key"))
    return code.config_value(subs, e.select(F.col("event_id").alias("path"), F.col("props").alias("text"))).select("event_id", "value")


@query("""SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN 'openssl' WHEN 1 THEN 'gnutls' END AS library, CASE c_nationkey % 3 WHEN 0 THEN 'ALG.AES' WHEN 1 THEN 'ALG.RSA' END AS profile_id FROM customer""")
def q_first_library(spark, sf_dir):
    apis = read(spark, sf_dir, "customer").select("c_custkey", pick(F.col("c_nationkey") % 3, "EVP_aes", "gnutls_rsa", "nothing").alias("api"))
    mapping = spark.createDataFrame([("evp_AES", "openssl", "ALG.AES", 1), ("evp_aes", "other", "ALG.X", 2), ("gnutls_rsa", "gnutls", "ALG.RSA", 3)], "api_name string, library string, profile_id string, ord int")
    return code.first_library(apis, mapping, "api").select("c_custkey", "library", "profile_id")


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'RSA' WHEN 1 THEN 'AES' END AS family, p_size % 3 = 0 OR p_size % 3 = 1 AS concrete, CASE p_size % 3 WHEN 0 THEN 'PKE' WHEN 1 THEN 'AES-128' ELSE 'KEY' END AS tail FROM part""")
def q_profile_names(spark, sf_dir):
    p = pick(F.col("p_size") % 3, "ALG.RSA.PKE", "ALG.AES-128", "UTIL.UNKNOWN::KEY")
    fam = F.when(F.col("p_size") % 3 != 2, names.family(p))
    return read(spark, sf_dir, "part").select("p_partkey", fam.alias("family"), names.is_concrete(p).alias("concrete"), names.function_tail(p).alias("tail"))


@query("""SELECT user_id, min(event_type) FILTER (WHERE event_id = m) AS event_type, c AS confidence FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS m, max(value) OVER (PARTITION BY user_id) AS c FROM events) GROUP BY user_id, c""")
def q_first_known(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("value", "confidence")
    return state.first_known(e, ["user_id"], ["event_type"], "event_id")
