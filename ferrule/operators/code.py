"""Operators over fact tables of source code: library detection and pruning, noise filters, builder chains, defaults, configuration lookups, use-def
steps, control-flow paths, inlining, attribution and identification ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algorithms, bits, linear, names
from ..sources.shared import cut
from .rank import best

# Libraries of import prefixes and of C symbol prefixes.
LIBRARIES = {"openssl": "openssl", "gnutls": "gnutls", "sodium": "libsodium", "mbedtls": "mbedtls", "Crypto": "pycryptodome", "nacl": "pynacl", "cryptography": "cryptography", "hashlib": "hashlib", "gmssl": "gmsm", "javax.crypto": "jca", "java.security": "jca", "org.bouncycastle": "bouncycastle", "crypto.": "go-crypto", "golang.org.x.crypto": "go-crypto"}
SYMBOL_PREFIXES = {"EVP_": "openssl", "RSA_": "openssl", "AES_": "openssl", "gnutls_": "gnutls", "crypto_": "libsodium", "mbedtls_": "mbedtls"}
# Tails of calls that never are findings, by kind.
RESULT_GETTERS = ["digest", "hexdigest", "getEncoded", "getPublic", "getPrivate", "export_key", "public_key"]
NOISE_TAILS = ["update", "finalize", "compare", "copy", "close", "doFinal"]
LIFECYCLE_TAIL = "_free$|_cleanup$|_clear$"
QUERY_TAIL = "_size$|_length$|_get_.*"
ALLOCATORS = {"c": ["_new$", "_CTX_new$", "malloc$"], "java": ["getInstance$", "^new "], "python": [r"\.new$", r"^[A-Z]\w*$"], "go": [r"\.New\w*$", "^new$", "^make$"]}


def libraries(imports: DataFrame) -> DataFrame:
    """(file_path, library) of import targets by prefix."""
    target = F.replace("target", F.lit("/"), F.lit("."))
    hit = F.coalesce(*[F.when(target.startswith(p), F.lit(lib)) for p, lib in LIBRARIES.items()])
    return imports.select("file_path", hit.alias("library")).where("library is not null").distinct()


def libraries_of_symbols(calls: DataFrame) -> DataFrame:
    hit = F.coalesce(*[F.when(F.col("symbol").startswith(p), F.lit(lib)) for p, lib in SYMBOL_PREFIXES.items()])
    return calls.select("file_path", hit.alias("library")).where("library is not null").distinct()


def active_rules(rules: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Rules (with `library`) of libraries in use anywhere: by imports, else by symbols. A semi-join before any matching."""
    used = libraries(imports).unionByName(libraries_of_symbols(calls)).select("library").distinct()
    return rules.join(F.broadcast(used), "library", "left_semi")


def without_noise(findings: DataFrame) -> DataFrame:
    """Drops result getters on chained calls, update-like tails, lifecycle calls, mode constants; query-like calls stay as info and are tagged."""
    tail = names.function_tail(F.col("symbol"))
    getter = tail.isin(RESULT_GETTERS) & F.coalesce(F.col("receiver").contains("("), F.lit(False))
    drop = getter | tail.isin(NOISE_TAILS) | tail.rlike(LIFECYCLE_TAIL) | F.col("symbol").rlike(r"\bmodes\.")
    query = tail.rlike(QUERY_TAIL)
    return findings.where(~drop).withColumn("auxiliary", query).withColumn("severity", F.when(query, "info").otherwise(F.col("severity")))


def plausible_bits(findings: DataFrame) -> DataFrame:
    """Nulls sizes that can't be: RSA, DSA and DH below 1024, EC of 128, others that are no known size."""
    family, size = F.coalesce(names.family(F.col("profile_id")), F.lit("")), F.col("key_bits")
    bad = (family.isin("RSA", "DSA", "DH") & (size < 1024)) | (family.isin("EC", "ECDSA", "ECDH") & (size == 128)) | ~bits.is_valid_bits(size)
    return findings.withColumn("key_bits", F.when(~F.coalesce(bad, F.lit(False)), size))


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON text's top level, as text."""
    return F.get_json_object(text, f"$.{name}")


def anchored(contracts: DataFrame, native: DataFrame) -> DataFrame:
    """Wrapper contracts whose chain holds a native symbol."""
    hit = contracts.select("name", F.explode("chain").alias("symbol")).join(native.select("symbol").distinct(), "symbol", "left_semi").select("name").distinct()
    return contracts.join(hit, "name", "left_semi")


def keep_strict(findings: DataFrame) -> DataFrame:
    """Rows with any of the confirming flags: exact, symbolic, context, project wrapper, confirmed chain, receiver context."""
    flags = ["exact", "symbolic", "context", "project_wrapper", "confirmed_chain", "receiver_context"]
    return findings.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))


def builder_chain(code: Column) -> Column:
    """map of setters of A.b().c(x).d(): tail -> argument text, in one fold over the pieces of the chain."""
    parts = F.filter(F.split(code, r"\)\s*\."), lambda p: p.contains("("))
    pair = lambda p: F.struct(names.last_segment(F.substring_index(p, "(", 1)).alias("key"), F.regexp_replace(F.substring(p, F.instr(p, "(") + 1, F.length(p)), r"\)\s*;?\s*$", "").alias("value"))
    return F.map_from_entries(F.transform(parts, pair))


def default_value(code: Column) -> Column:
    """The default of os.getenv(k, d), os.environ.get(k, d), config.get(k, d), inside int(..) or not."""
    inner = F.regexp_replace(code, r"^\s*int\((.*)\)\s*$", "$1")
    return F.nullif(F.regexp_replace(F.regexp_extract(inner, r"(?:getenv|\.get)\(\s*[^,()]+,\s*([^()]+?)\s*\)", 1), r"""^["']|["']$""", ""), F.lit(""))


def go_array_bits(signature: Column, parameter: Column) -> Column:
    """Bits of a parameter `name *[32]byte` or `name [32]byte` in a Go signature."""
    entries = F.regexp_extract_all(signature, F.lit(r"(\w+\s+\*?\[\d+\]byte)"), 1)
    own = F.get(F.filter(entries, lambda e: F.split(e, r"\s+")[0] == parameter), 0)
    return F.nullif(F.regexp_extract(own, r"\[(\d+)\]", 1), F.lit("")).cast("int") * 8


def config_value(subscripts: DataFrame, configs: DataFrame) -> DataFrame:
    """subscripts(path, key, ...) with the value at a top-level key of the JSON text configs(path, text)."""
    found = F.try_element_at(F.from_json("text", "map<string,string>"), F.col("key"))
    return subscripts.join(configs, "path", "left").withColumn("value", found).drop("text")


def is_allocator(lang: Column, symbol: Column) -> Column:
    return F.coalesce(*[F.when(lang == k, symbol.rlike("|".join(p))) for k, p in ALLOCATORS.items()], F.lit(False))


def first_library(apis: DataFrame, mapping: DataFrame, api: str) -> DataFrame:
    """apis with the profile of the first library (by ord) that knows the name."""
    low = mapping.select(F.lower("api_name").alias("__api"), "library", "profile_id", "ord")
    first = low.groupBy("__api").agg(F.min_by(F.struct("library", "profile_id"), "ord").alias("m"))
    return apis.join(F.broadcast(first), F.lower(F.col(api)) == F.col("__api"), "left").select(*[F.col(c) for c in apis.columns], "m.library", "m.profile_id")


def wrapper_rule(calls: DataFrame, rules: DataFrame, default: str = "WRAP.Generic") -> DataFrame:
    """calls with the first wrapper rule whose keyword their name contains, else the default. Rules are a dimension of a few rows."""
    met = calls.join(F.broadcast(rules.select("keyword", F.col("rule_id").alias("__rule"), "ord")), F.contains(F.lower("symbol"), "keyword"), "left")
    return best(met, ["call_id"], [F.col("ord").asc_nulls_last()]).withColumn("wrapper_rule", F.coalesce("__rule", F.lit(default))).drop("keyword", "__rule", "ord")


def pattern_scores(texts: DataFrame, patterns: list[tuple[str, str, float, list[str]]]) -> DataFrame:
    """Weighted heuristics (family, pattern, weight, languages): a column-wise sum per family; patterns are few, and an invalid one is left out."""
    import re

    sums: dict[str, list[Column]] = {}
    for family, pattern, weight, langs in patterns:
        try:
            re.compile(pattern)
        except re.error:
            continue
        hit = F.col("code").rlike(pattern) & (F.col("lang").isin(langs) if langs else F.lit(True))
        sums.setdefault(family, []).append(F.when(hit, weight).otherwise(0.0))
    return texts.select("file_path", *[reduce(lambda a, b: a + b, v).alias(k) for k, v in sums.items()])


def labelled_bits(labels: DataFrame, files: DataFrame, constants: list[str]) -> DataFrame:
    """(chain, bits): chain labels that name a file, with the first of the constants defined in it."""
    got = labels.join(files.select("file_path", "code"), "file_path")
    found = F.coalesce(*[F.nullif(F.regexp_extract("code", rf"\b{c}\b\s*=?\s*(\d{{2,5}})", 1), F.lit("")).cast("int") for c in constants])
    return got.select("chain", found.alias("bits"))


def fill_deep(a: Column, b: Column) -> Column:
    """Map a with the entries of b where a has none or an empty one."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(F.nullif(x, F.lit("")), y))


def forward_uses(defs: DataFrame, lines: DataFrame, most: int = 200) -> DataFrame:
    """(file_path, name, line) of lines after a definition, within `most`, that use its name as a word. Lines meet names by an equi-join on their words."""
    words = lines.select("file_path", F.col("line").alias("use_line"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"), 1))).alias("name"))
    met = defs.select("file_path", "name", "line").join(words, ["file_path", "name"])
    return met.where((F.col("use_line") > F.col("line")) & (F.col("use_line") <= F.col("line") + most)).select("file_path", "name", F.col("use_line").alias("line"))


def cfg_paths(edges: DataFrame, entry: DataFrame, max_paths: int = 100, max_depth: int = 50, max_visits: int = 3) -> DataFrame:
    """(func, path): paths of each function's blocks from its entry to blocks without successors. A block is seen max_visits times on a path; a level keeps the
    first max_paths of each function."""
    front = entry.select("func", F.col("block").alias("at"), F.array("block").alias("path"))
    ends = edges.select("func", F.col("dst").alias("at")).unionByName(entry.select("func", F.col("block").alias("at"))).distinct().join(edges.select("func", F.col("src").alias("at")).distinct(), ["func", "at"], "left_anti")
    done = None
    text = F.array_join(F.transform("path", lambda x: x.cast("string")), ">")
    for _ in range(max_depth):
        here = front.join(ends, ["func", "at"], "left_semi")
        done = here if done is None else done.unionByName(here)
        step = front.join(edges.select("func", F.col("src").alias("at"), "dst"), ["func", "at"])
        step = step.where(F.size(F.filter("path", lambda x: x == F.col("dst"))) < max_visits).select("func", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"))
        w = Window.partitionBy("func").orderBy(text)
        front = cut(step.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_paths).drop("__r"))
        if front.isEmpty():
            break
    w = Window.partitionBy("func").orderBy(F.size("path"), text)
    return done.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= max_paths).select("func", text.alias("path"))


def ssa(assignments: DataFrame) -> DataFrame:
    """Straight-line SSA: assignments with ssa_name, name_N, and operands: the names in the value at their version before this line."""
    w = Window.partitionBy("file_path", "function", "name").orderBy("line", "seq")
    numbered = assignments.withColumn("version", F.row_number().over(w) - 1).withColumn("ssa_name", F.concat_ws("_", "name", "version"))
    used = numbered.select("file_path", "function", "line", "seq", F.explode_outer(names.identifiers(F.col("value"))).alias("operand"))
    defs = numbered.select("file_path", "function", F.col("name").alias("operand"), F.col("line").alias("__l"), F.col("seq").alias("__s"), F.col("ssa_name").alias("__n"))
    met = used.join(defs, ["file_path", "function", "operand"], "left").where("__l is null or __l < line or (__l = line and __s < seq)")
    last = met.groupBy("file_path", "function", "line", "seq", "operand").agg(F.max_by("__n", F.struct("__l", "__s")).alias("n"))
    ops = last.groupBy("file_path", "function", "line", "seq").agg(F.array_sort(F.collect_set(F.coalesce("n", "operand"))).alias("operands"))
    return numbered.join(ops, ["file_path", "function", "line", "seq"], "left")


def inline_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls with `inlined`, the callee's return expression with its parameters replaced by the call's arguments, in one fold."""
    f = functions.where("return_expression is not null").select(names.function_tail(F.col("name")).alias("__tail"), "return_expression", "params").dropDuplicates(["__tail"])
    got = calls.withColumn("__tail", names.function_tail(F.col("symbol"))).join(f, "__tail", "left")
    pairs = F.arrays_zip(F.col("params").alias("p"), F.slice("args", 1, F.greatest(F.size("params"), F.lit(0))).alias("a"))
    body = F.aggregate(pairs, F.col("return_expression"), lambda s, x: F.when(x.a.isNull(), s).otherwise(F.regexp_replace(s, F.concat(F.lit(r"\b"), x.p, F.lit(r"\b")), F.concat(F.lit("("), F.regexp_replace(x.a, r"([\\$])", r"\\$1"), F.lit(")")))))
    return got.withColumn("inlined", body).drop("__tail", "return_expression", "params")


def bind_parameters(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(call_id, param, kind, source, mul, div, add, value): each argument on its callee's parameter, in linear form."""
    f = functions.select(names.function_tail(F.col("name")).alias("__tail"), "params").dropDuplicates(["__tail"])
    got = calls.withColumn("__tail", names.function_tail(F.col("symbol"))).join(f, "__tail")
    rows = got.select("call_id", F.posexplode("params").alias("i", "param"), "args").withColumn("arg", F.get("args", F.col("i"))).where("arg is not null")
    return rows.select("call_id", "param", linear.binding(F.col("arg")).alias("b")).select("call_id", "param", "b.*")


def trace_parameter(bindings: DataFrame, owners: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """(seed, value): constants that reach a seed (func, param) through callers. bindings: (callee, param, caller, kind, source, mul, div, add, value)."""
    front = seeds.select(F.concat_ws(".", "func", "param").alias("seed"), "func", "param", F.lit(1).cast("long").alias("m"), F.lit(1).cast("long").alias("d"), F.lit(0).cast("long").alias("a"))
    out = None
    b = bindings.select(F.col("callee").alias("func"), "param", "caller", "kind", "source", "mul", "div", "add", "value")
    for _ in range(max_depth):
        met = cut(front.join(b, ["func", "param"]))
        here = met.where("kind = 'constant'").select("seed", linear.apply(F.col("value"), F.col("m"), F.col("d"), F.col("a")).alias("value"))
        out = here if out is None else out.unionByName(here)
        up = met.where("kind in ('variable', 'linear') and div = 1").select("seed", F.col("caller").alias("func"), F.col("source").alias("param"), (F.col("m") * F.col("mul")).alias("m"), "d", (F.col("a") + F.floor(F.col("m") * F.col("add") / F.col("d"))).alias("a"))
        front = cut(up.join(owners, ["func", "param"], "left_semi").distinct())
        if front.isEmpty():
            break
    return out.distinct()


def key_input(calls: DataFrame, params: DataFrame) -> DataFrame:
    """calls(call_id, owner_function, arg) with `input_source`: CONST, PARAM (a parameter of the owner, plain or linear), STATE (a field), UNKNOWN."""
    b = linear.binding(F.col("arg"))
    p = params.select(F.col("func").alias("owner_function"), F.col("param").alias("__p")).distinct()
    got = calls.withColumn("__b", b).withColumn("__src", F.col("__b.source")).join(p, (F.col("__src") == F.col("__p")) & (calls["owner_function"] == p["owner_function"]), "left").drop(p["owner_function"])
    literal = F.col("arg").rlike(r"^\s*(?:b?['\"]|\d)")
    field = F.col("arg").rlike(r"^\s*(?:self|this)\.|->|^\s*\w+\.\w+\s*$")
    return got.withColumn("input_source", F.when(literal, "CONST").when(F.col("__p").isNotNull(), "PARAM").when(field, "STATE").otherwise("UNKNOWN")).drop("__b", "__src", "__p")


def contracts_of(derived: DataFrame) -> DataFrame:
    """Wrapper contracts (api_id, function, profile_id, param, predicate, value, confidence) of derived constraints: confirmed if derived exactly and by one hop, probable if through more,
    suspect otherwise."""
    confidence = F.when(F.col("derived").isNull(), "suspect").when(F.size("chain") <= 2, "confirmed").otherwise("probable")
    return derived.select(F.concat(F.lit("wrap."), "function").alias("api_id"), "function", "profile_id", F.col("source").alias("param"), "predicate", F.col("derived").alias("value"), confidence.alias("confidence"))


def vulnerabilities(findings: DataFrame, constraints: DataFrame) -> DataFrame:
    """Findings of profiles without any resistant size (inherent), or below the resistant minimum; unknown sizes of the latter are passed over."""
    c = constraints.where("mode = 'quantum' and param = 'key_bits'").select("profile_id", "min_bits", "has_min", "severity", "migrate_to")
    got = findings.join(F.broadcast(c.withColumnRenamed("severity", "__s")), "profile_id")
    hit = ~F.col("has_min") | (F.col("key_bits") < F.col("min_bits"))
    return got.where(hit).withColumn("inherent", ~F.col("has_min")).drop("min_bits", "has_min", "__s")


def identify(calls: DataFrame, own_functions: DataFrame) -> DataFrame:
    """calls with (profile_id, tier) of the identification ladder; its inputs are columns, null where a tier has no answer: wrapper_profile, api_profile, arg_state_profile,
    receiver_profile, arg (a transformation text), library_profile. Functions of the tree itself have no algorithm."""
    own = own_functions.select(F.col("name").alias("symbol"), F.lit(True).alias("__own")).distinct()
    part = algorithms.profile_of_name(F.get(F.filter(F.split("symbol", r"[._]"), lambda p: algorithms.profile_of_name(p).isNotNull()), 0))
    tiers = [F.col("wrapper_profile"), F.when(names.is_concrete(F.col("api_profile")), F.col("api_profile")), F.col("arg_state_profile"), F.col("receiver_profile"), algorithms.transformation_profile(F.col("arg")), F.col("library_profile"), part]
    got = calls.join(own, "symbol", "left")
    free = F.col("__own").isNull()
    tier = F.coalesce(*[F.when(t.isNotNull(), i + 1) for i, t in enumerate(tiers)])
    return got.withColumn("profile_id", F.when(free, F.coalesce(*tiers))).withColumn("tier", F.when(free, tier)).drop("__own")


def method_effects(calls: DataFrame, effects: DataFrame) -> DataFrame:
    """(file_path, object, line, seq, field, value): what calls on objects write, by the effect table (method, field, arg, transform)."""
    e = F.broadcast(effects.select("method", "field", F.col("arg").alias("__arg"), "transform"))
    got = calls.where("receiver is not null").join(e, names.last_segment(F.col("symbol")) == F.col("method"))
    v = bits.safe_int(F.get("args", F.col("__arg")))
    value = F.when(F.col("transform") == "bytes_to_bits", v * 8).when(F.col("transform") == "bits_to_bytes", F.floor(v / 8).cast("long")).otherwise(v)
    return got.select("file_path", F.col("receiver").alias("object"), "line", "seq", "field", value.alias("value"))


def loop_context(edges: DataFrame, facts: DataFrame, rounds: int = 8) -> DataFrame:
    """(var, value): values carried along assignments between variables until nothing changes (algorithm variable -> context variable)."""
    seen = cut(facts.select("var", "value").distinct())
    front = seen
    for _ in range(rounds):
        new = front.join(edges.select(F.col("src").alias("var"), "dst"), "var").select(F.col("dst").alias("var"), "value").distinct().join(seen.select("var").distinct(), "var", "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
