"""Operators over facts on small tables."""

from pyspark.sql import functions as F

from ferrule.operators import code


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_libraries_and_pruning(spark):
    imports = spark.createDataFrame([("a.py", "Crypto.Cipher"), ("b.go", "crypto/aes"), ("c.c", "stdio.h")], "file_path string, target string")
    calls = spark.createDataFrame([("c.c", "EVP_sha1")], "file_path string, symbol string")
    rules = spark.createDataFrame([("r1", "pycryptodome"), ("r2", "openssl"), ("r3", "gnutls")], "rule string, library string")
    assert rows(code.libraries(imports), "file_path", "library") == [("a.py", "pycryptodome"), ("b.go", "go-crypto")]
    assert rows(code.active_rules(rules, imports, calls), "rule") == [("r1",), ("r2",)]


def test_noise_and_bits(spark):
    f = spark.createDataFrame([("hashlib.md5", None, "high", "ALG.MD5", 128), ("h.update", "h", "high", "ALG.MD5", 128), ("EVP_CIPHER_CTX_free", None, "high", "ALG.AES", 128), ("EVP_MD_size", None, "high", "ALG.RSA", 900), ("x.digest", "hashlib.md5(b)", "high", "ALG.RSA", 512)], "symbol string, receiver string, severity string, profile_id string, key_bits int")
    assert rows(code.without_noise(f), "symbol", "severity", "auxiliary") == [("EVP_MD_size", "info", True), ("hashlib.md5", "high", False)]
    assert rows(code.plausible_bits(f), "symbol", "key_bits")[0] == ("EVP_CIPHER_CTX_free", 128)
    assert ("EVP_MD_size", None) in rows(code.plausible_bits(f), "symbol", "key_bits") and ("x.digest", None) in rows(code.plausible_bits(f), "symbol", "key_bits")


def test_texts(spark):
    assert one(spark, code.default_value, 'os.getenv("BITS", "2048")', 'int(os.environ.get("B", 1024))', "f(x)") == ["2048", "1024", None]
    assert one(spark, lambda x: code.go_array_bits(x, F.lit("key")), "func f(key *[32]byte, iv [16]byte)", "func g(a int)") == [256, None]
    assert one(spark, code.builder_chain, 'Jwts.builder().setKey(k).bits(256).build()')[0] == {"builder": "", "setKey": "k", "bits": "256", "build": ""}
    assert one(spark, lambda x: code.is_allocator(F.lit("c"), x), "EVP_CIPHER_CTX_new", "EVP_free") == [True, False]


def test_config_and_maps(spark):
    subs = spark.createDataFrame([("a.json", "bits"), ("a.json", "none"), ("b.json", "x")], "path string, key string")
    conf = spark.createDataFrame([("a.json", '{"bits": 2048}')], "path string, text string")
    assert rows(code.config_value(subs, conf), "path", "key", "value") == [("a.json", "bits", "2048"), ("a.json", "none", None), ("b.json", "x", None)]
    m = spark.range(1).select(code.fill_deep(F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("c"), F.lit("3"))).alias("m")).first().m
    assert m == {"a": "2", "b": "1", "c": "3"}


def test_lookups(spark):
    apis = spark.createDataFrame([("EVP_AES",), ("other",)], "api string")
    mapping = spark.createDataFrame([("evp_aes", "gnutls", "ALG.X", 2), ("EVP_aes", "openssl", "ALG.AES", 1)], "api_name string, library string, profile_id string, ord int")
    assert rows(code.first_library(apis, mapping, "api"), "api", "library") == [("EVP_AES", "openssl"), ("other", None)]
    calls = spark.createDataFrame([("1", "my_Encrypt_it"), ("2", "foo")], "call_id string, symbol string")
    rules = spark.createDataFrame([("encrypt", "WRAP.Enc", 1), ("it", "WRAP.It", 2)], "keyword string, rule_id string, ord int")
    assert rows(code.wrapper_rule(calls, rules), "call_id", "wrapper_rule") == [("1", "WRAP.Enc"), ("2", "WRAP.Generic")]
    texts = spark.createDataFrame([("f", "c", "RSA_new(); rsa"), ("g", "go", "rsa")], "file_path string, lang string, code string")
    assert rows(code.pattern_scores(texts, [("rsa", "RSA_", 2.0, ["c"]), ("rsa", "rsa", 0.5, []), ("bad", "(", 1.0, [])]), "file_path", "rsa") == [("f", 2.5), ("g", 0.5)]


def test_flow(spark):
    edges = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 1, 1), ("f", 0, 2)], "func string, src int, dst int")
    entry = spark.createDataFrame([("f", 0), ("g", 0)], "func string, block int")
    assert rows(code.cfg_paths(edges, entry, max_visits=2), "func", "path") == [("f", "0>1>1>2"), ("f", "0>1>2"), ("f", "0>2"), ("g", "0")]
    a = spark.createDataFrame([("p", "f", "x", 1, 1, "1"), ("p", "f", "x", 2, 2, "x + y"), ("p", "f", "z", 3, 3, "x")], "file_path string, function string, name string, line int, seq int, value string")
    assert rows(code.ssa(a), "ssa_name", "operands") == [("x_0", None), ("x_1", ["x_0", "y"]), ("z_0", ["x_1"])] or rows(code.ssa(a), "ssa_name", "operands") == [("x_0", []), ("x_1", ["x_0", "y"]), ("z_0", ["x_1"])]
    defs = spark.createDataFrame([("p", "bits", 1)], "file_path string, name string, line int")
    lines = spark.createDataFrame([("p", 2, "gen(bits)"), ("p", 3, "mybits"), ("p", 400, "bits")], "file_path string, line int, text string")
    assert rows(code.forward_uses(defs, lines), "line") == [(2,)]


def test_calls(spark):
    calls = spark.createDataFrame([("1", "m.twice", ["n + 1"], "main"), ("2", "unknown", ["3"], "main"), ("3", "twice", ["4"], "main")], "call_id string, symbol string, args array<string>, owner_function string")
    funcs = spark.createDataFrame([("twice", "x * 2", ["x"])], "name string, return_expression string, params array<string>")
    assert rows(code.inline_calls(calls, funcs), "call_id", "inlined") == [("1", "(n + 1) * 2"), ("2", None), ("3", "(4) * 2")]
    got = rows(code.bind_parameters(calls, funcs), "call_id", "param", "kind", "add", "value")
    assert got == [("1", "x", "linear", 1, None), ("3", "x", "constant", 0, 4)]
    b = spark.createDataFrame([("gen", "bits", "mid", "linear", "kb", 8, 1, 0, None), ("mid", "kb", "main", "constant", None, 1, 1, 0, 256)], "callee string, param string, caller string, kind string, source string, mul long, div long, add long, value long")
    owners = spark.createDataFrame([("mid", "kb")], "func string, param string")
    seeds = spark.createDataFrame([("gen", "bits")], "func string, param string")
    assert rows(code.trace_parameter(b, owners, seeds), "seed", "value") == [("gen.bits", 2048)]
    k = spark.createDataFrame([("1", "f", "2048"), ("2", "f", "n * 8"), ("3", "f", "self.bits"), ("4", "f", "g(h)"), ("5", "g", "n")], "call_id string, owner_function string, arg string")
    params = spark.createDataFrame([("f", "n")], "func string, param string")
    assert [r[1] for r in rows(code.key_input(k, params), "call_id", "input_source")] == ["CONST", "PARAM", "STATE", "UNKNOWN", "UNKNOWN"]


def test_identify(spark):
    schema = "symbol string, wrapper_profile string, api_profile string, arg_state_profile string, receiver_profile string, arg string, library_profile string"
    calls = spark.createDataFrame([("own", None, "ALG.AES", None, None, None, None), ("a.gen", None, "UTIL.X", None, "ALG.DES", None, None), ("c.get", None, None, None, None, "AES/GCM", None), ("x.rsa_new", None, None, None, None, None, None), ("q", None, None, None, None, None, None)], schema)
    own = spark.createDataFrame([("own",)], "name string")
    assert rows(code.identify(calls, own), "symbol", "profile_id", "tier") == [("a.gen", "ALG.DES", 4), ("c.get", "ALG.AES", 5), ("own", None, None), ("q", None, None), ("x.rsa_new", "ALG.RSA", 7)]


def test_effects_and_context(spark):
    calls = spark.createDataFrame([("p", "kg.init", "kg", 9, 1, ["16"]), ("p", "f", None, 9, 2, ["1"])], "file_path string, symbol string, receiver string, line int, seq int, args array<string>")
    effects = spark.createDataFrame([("init", "key_bits", 0, "bytes_to_bits")], "method string, field string, arg int, transform string")
    assert rows(code.method_effects(calls, effects), "object", "field", "value") == [("kg", "key_bits", 128)]
    edges = spark.createDataFrame([("alg", "ctx"), ("ctx", "ctx2"), ("ctx2", "alg")], "src string, dst string")
    facts = spark.createDataFrame([("alg", "AES")], "var string, value string")
    assert rows(code.loop_context(edges, facts), "var", "value") == [("alg", "AES"), ("ctx", "AES"), ("ctx2", "AES")]


def test_vulnerabilities(spark):
    f = spark.createDataFrame([(1, "ALG.RSA.PKE", None), (2, "ALG.AES", 128), (3, "ALG.AES", 256), (4, "ALG.AES", None)], "i int, profile_id string, key_bits int")
    c = spark.createDataFrame([("ALG.RSA.PKE", "quantum", "key_bits", None, False, "critical", ["ML-KEM"]), ("ALG.AES", "quantum", "key_bits", 256, True, None, [])], "profile_id string, mode string, param string, min_bits long, has_min boolean, severity string, migrate_to array<string>")
    assert rows(code.vulnerabilities(f, c), "i", "inherent") == [(1, True), (2, False)]
    d = spark.createDataFrame([("f", "ALG.RSA", "n", "GEQ", 384, ["a", "b"]), ("g", "ALG.RSA", "n", "GEQ", 384, ["a", "b", "c"]), ("h", "ALG.RSA", "n", "GEQ", None, ["a"])], "function string, profile_id string, source string, predicate string, derived long, chain array<string>")
    assert [r[1] for r in rows(code.contracts_of(d), "function", "confidence")] == ["confirmed", "probable", "suspect"]


def test_anchors_and_strict(spark):
    c = spark.createDataFrame([("f", ["f", "RSA_new"]), ("g", ["g", "x"])], "name string, chain array<string>")
    native = spark.createDataFrame([("RSA_new",)], "symbol string")
    assert rows(code.anchored(c, native), "name") == [("f",)]
    s = spark.createDataFrame([(1, True, None, None, None, None, None), (2, None, None, None, None, None, None)], "i int, exact boolean, symbolic boolean, context boolean, project_wrapper boolean, confirmed_chain boolean, receiver_context boolean")
    assert rows(code.keep_strict(s), "i") == [(1,)]
    lab = spark.createDataFrame([("w [a.c]", "a.c")], "chain string, file_path string")
    src = spark.createDataFrame([("a.c", "const int KEY_BITS = 2048;")], "file_path string, code string")
    assert rows(code.labelled_bits(lab, src, ["RSA_BITS", "KEY_BITS"]), "bits") == [(2048,)]
