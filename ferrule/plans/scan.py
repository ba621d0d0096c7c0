"""The scan of a source tree as one DAG of tables: files -> facts -> rule matches -> key sizes -> wrappers -> constraints -> findings -> report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algorithms, bits, expressions, levels, linear, names
from ..operators import asof, code, constraint, match, rank, report, resolve
from ..sources import files as source_files
from ..sources import kb as knowledge
from ..sources.shared import cut
from . import extract, registry

MAX_WRAPPER_LEVELS = 8
FINDING = ["file_path", "lang", "line", "symbol", "profile_id", "family", "key_bits", "mode", "severity", "reason", "wrapper_chain", "rule_id", "owner_function"]


def _argument(args: Column, index: Column) -> Column:
    """Text of a positional argument, without a keyword."""
    return F.regexp_replace(F.get(args, index), r"^[A-Za-z_]\w*=(?!=)", "")


def matched_calls(calls: DataFrame, imports: DataFrame, rules: DataFrame, by_import: bool = True) -> DataFrame:
    """calls with their best rule: names meet on the last segment, aliases resolved; the rule's imports, if it has any, must be met by the file; the longest rule symbol
    wins, then list order. Functions of the tree itself are told apart later, by their names."""
    aliases = imports.select("file_path", "alias", "target").dropDuplicates(["file_path", "alias"])
    named = match.resolve_alias(calls, aliases, "file_path", "symbol")
    required = F.col("imports") if by_import and "imports" in rules.columns else F.array().cast("array<string>")
    r = rules.select(F.col("lang").alias("__lang"), F.col("symbol").alias("rule_symbol"), F.col("api_id").alias("rule_id"), F.col("profile_id").alias("rule_profile"), "bits_arg", "bits_unit", "arg_kind", "category", "ord", required.alias("rule_imports"))
    met = match.suffix_join(named, resolve.small(r), "resolved", "rule_symbol").where(F.col("lang") == F.col("__lang"))
    # a bare tail says nothing: a rule of two segments must meet two
    enough = (~F.contains("rule_symbol", F.lit("."))) | F.col("resolved").endswith(F.concat(F.lit("."), F.col("rule_symbol"))) | (F.col("resolved") == F.col("rule_symbol"))
    met = met.where(enough)
    # only files that have a match are asked what they import
    have = imports.join(met.select("file_path").distinct(), "file_path", "left_semi").groupBy("file_path").agg(F.collect_set("target").alias("__have"))
    met = met.join(have, "file_path", "left").where(resolve.import_meets(F.coalesce("__have", F.array().cast("array<string>")), F.col("rule_imports"))).drop("__have", "rule_imports")
    best = rank.best(met, ["call_id"], [F.length("rule_symbol").desc(), F.col("ord")])
    return best.where(~names.is_random(F.col("rule_profile"))).drop("__lang")


def quick_scan(spark: SparkSession, folder: str, recursive: bool = True, langs: list[str] | None = None) -> DataFrame:
    """The calls of a source tree, without any rule."""
    return extract.facts(cut(extract.extract(source_files.scan(spark, folder, recursive, langs))))["calls"]


def _sizes(calls: DataFrame, assignments: DataFrame, arg: str) -> DataFrame:
    """calls with `arg_value` (whole number) and `arg_text` after looking variables up: the last assignment in the function at or before the line, then the
    file's, then its last of all."""
    defs = assignments.select("file_path", F.coalesce("function", F.lit("")).alias("scope"), "name", F.col("line").alias("def_line"), F.col("seq").alias("def_seq"), F.col("value").alias("def_value"))
    use = calls.withColumn("scope", F.coalesce("owner_function", F.lit(""))).withColumn("name", F.col(arg))
    local = asof.backward(use, defs, ["file_path", "scope", "name"], "line", "def_line", ["def_value"], "def_seq").withColumnRenamed("def_value", "__local")
    top = defs.where("scope = ''").groupBy("file_path", "name").agg(F.max_by("def_value", F.struct("def_line", "def_seq")).alias("__global"))
    got = local.join(top, ["file_path", "name"], "left")
    text = F.coalesce("__local", "__global", F.col(arg))
    return got.withColumn("arg_text", text).withColumn("arg_value", F.coalesce(bits.safe_int(text), expressions.evaluate(text))).drop("scope", "name", "__local", "__global")


def direct_findings(calls: DataFrame, assignments: DataFrame) -> DataFrame:
    """Findings of calls that a rule matches, with profile and key size from their own arguments."""
    arg = calls.withColumn("arg", F.when(F.col("bits_arg") >= 0, _argument(F.col("args"), F.col("bits_arg"))))
    sized = _sizes(arg, assignments, "arg")
    text = F.regexp_replace(F.trim("arg_text"), r"""^["']|["']$""", "")
    t = algorithms.transformation(text)
    dynamic = F.col("arg_kind") == "transformation"
    profile = F.when(dynamic, F.coalesce(algorithms.transformation_profile(text), "rule_profile")).otherwise(F.col("rule_profile"))
    whole = F.col("arg_value")
    size = F.when(F.col("arg_kind") == "name", bits.api_name_bits(names.function_tail(F.col("symbol")))).when(F.col("arg_kind") == "curve", bits.curve_bits(F.regexp_extract(F.col("arg_text"), r"([A-Za-z0-9_-]+)(?:\(\))?$", 1))).when(F.col("arg_kind") == "size", F.when(F.col("bits_unit") == "bytes", whole * 8).otherwise(whole)).when(F.col("arg_kind") == "key", F.coalesce(bits.expression_bits(F.col("arg_text")), F.when(whole.isNotNull(), bits.bytes_or_bits(whole)))).when(dynamic & (algorithms.transformation_profile(text) == "ALG.3DES"), 168).when(dynamic, bits.cipher_bits(text))
    mode = F.coalesce(F.when(dynamic, t.mode), algorithms.mode_of(F.concat_ws(",", "args")), algorithms.mode_of(F.col("symbol")))
    out = sized.withColumn("profile_id", F.when(F.col("rule_profile") == "ALG.RSA", algorithms.classify_public_key(profile, F.col("symbol"))).otherwise(profile)).withColumn("key_bits", F.when(bits.is_valid_bits(size), size.cast("long"))).withColumn("mode", mode)
    return out.withColumn("wrapper_chain", F.array().cast("array<string>"))


def with_initialisers(found: DataFrame, calls: DataFrame) -> DataFrame:
    """found with key sizes of factories set by the first init call after them on the variable they were assigned to."""
    inits = calls.where(names.last_segment(F.col("symbol")).isin("init", "initialize")).select("file_path", F.col("owner_function").alias("__owner"), F.col("receiver").alias("__var"), F.col("seq").alias("__seq"), bits.safe_int(F.get("args", 0)).alias("__bits"))
    met = found.where("category = 'factory'").select("call_id", "file_path", "owner_function", "assigned_to", "seq").join(inits, "file_path").where(F.col("__owner").eqNullSafe(F.col("owner_function")) & (F.col("__var") == F.col("assigned_to")) & (F.col("__seq") > F.col("seq")) & bits.is_valid_bits(F.col("__bits")))
    first = met.groupBy("call_id").agg(F.min_by("__bits", "__seq").alias("__init"))
    return found.join(first, "call_id", "left").withColumn("key_bits", F.coalesce("__init", "key_bits")).drop("__init")


def wrapper_findings(found: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Findings at the call sites of wrappers: functions whose parameter, linearly transformed, becomes a matched call's size, and their callers in turn.
    Names are matched by their last segment and only if one function of the language has it. One join per level, and a function is resolved once."""
    funcs = functions.select("file_path", "lang", F.col("name").alias("func"), names.function_tail(F.col("name")).alias("tail"), "params", "line", "end_line")
    alone = funcs.groupBy("lang", "tail").agg(F.count("*").alias("__n")).where("__n = 1").select("lang", "tail")
    params = cut(funcs.join(alone, ["lang", "tail"], "left_semi").select("file_path", "func", F.concat_ws(":", "lang", "tail").alias("tail"), "params"))
    unit = F.when(F.col("bits_unit") == "bytes", 8).otherwise(1).cast("long")
    seed = found.where("owner_function <> ''").join(params.withColumnRenamed("func", "owner_function"), ["file_path", "owner_function"]).withColumn("b", linear.binding(F.col("arg")))
    at = F.array_position("params", F.col("b.source"))
    calls = calls.join(found.select("call_id"), "call_id", "left_anti")  # what a rule matches is no call of a wrapper
    known = seed.where(F.col("b.kind").isin("variable", "linear") & (at > 0)).select("tail", (at.cast("int") - 1).alias("at"), (F.col("b.mul") * unit).alias("mul"), F.col("b.div").alias("div"), (F.col("b.add") * unit).alias("add"), "profile_id", F.array("symbol", F.col("owner_function")).alias("chain"), "rule_id", "mode")
    known = cut(rank.best(known, ["tail"], [F.col("rule_id"), F.col("at")]))
    seen, out = known.select("tail"), None
    for _ in range(MAX_WRAPPER_LEVELS):
        site = calls.withColumn("tail", F.concat(F.col("lang"), F.lit(":"), names.function_tail(F.col("symbol")))).join(known, "tail").withColumn("b", linear.binding(_argument(F.col("args"), F.col("at"))))
        value = linear.apply(F.col("b.value"), F.col("mul"), F.col("div"), F.col("add"))
        here = site.select("file_path", "lang", "line", "seq", "symbol", "owner_function", "call_id", "profile_id", F.when(bits.is_valid_bits(value), value).alias("key_bits"), "mode", F.col("chain").alias("wrapper_chain"), "rule_id")
        here = cut(here)
        out = here if out is None else out.unionByName(here)
        up = site.where("owner_function <> '' and b.kind in ('variable', 'linear') and b.div = 1").join(params.select("file_path", F.col("func").alias("owner_function"), F.col("tail").alias("__tail"), "params"), ["file_path", "owner_function"])
        pos = F.array_position("params", F.col("b.source"))
        up = up.where(pos > 0).select(F.col("__tail").alias("tail"), (pos.cast("int") - 1).alias("at"), (F.col("mul") * F.col("b.mul")).alias("mul"), "div", (F.col("add") + F.floor(F.col("mul") * F.col("b.add") / F.col("div"))).alias("add"), "profile_id", F.concat("chain", F.array("owner_function")).alias("chain"), "rule_id", "mode")
        known = cut(rank.best(up.join(seen, "tail", "left_anti"), ["tail"], [F.size("chain"), F.col("rule_id")]))
        if known.isEmpty():
            break
        seen = seen.unionByName(known.select("tail"))
    return out


def rated(findings: DataFrame, dims: dict[str, DataFrame], whitelist: list[str] = ()) -> DataFrame:
    """findings with the worst violation of their profile's constraints, severity and reason."""
    v = constraint.check(findings.select("call_id", "profile_id", "key_bits", F.col("mode").alias("block_mode"), F.concat_ws(">", "wrapper_chain").alias("chain")), dims["constraints"].drop("migrate_to"), {"key_bits": "key_bits"}, "block_mode")
    level = levels.of_constraint(F.col("level"))
    worst = rank.best(v.withColumn("__level", level), ["call_id", "chain"], [levels.rank(F.col("__level")).desc(), F.col("mode").desc(), F.col("parameter")]).select("call_id", "chain", F.col("__level").alias("worst"), F.col("reason").alias("why"))
    p = dims["profiles"].select("profile_id", "family", "quantum_secure", "q_security_bits", F.col("reason").alias("profile_reason"))
    got = findings.withColumn("chain", F.concat_ws(">", "wrapper_chain")).join(worst, ["call_id", "chain"], "left").join(F.broadcast(p), "profile_id", "left")
    none = F.lit(None).cast("string")
    ladder = levels.of_profile(none, F.lit(None).cast("long"), none, F.col("quantum_secure"), F.col("q_security_bits"), F.col("key_bits"))
    free = F.col("profile_id").isin(list(whitelist)) if whitelist else F.lit(False)
    severity = F.when(free, "low").when(F.col("profile_reason").isNull() & F.col("family").isNull(), "medium").otherwise(F.coalesce("worst", ladder))
    return got.withColumn("severity", severity).withColumn("reason", F.coalesce("why", "profile_reason", levels.unknown_reason(F.col("profile_id")))).withColumn("family", F.coalesce("family", names.family(F.col("profile_id"))))


def dedup(findings: DataFrame) -> DataFrame:
    """One finding per file, line, symbol and profile: the longest wrapper chain, concrete profiles first, then severity, then place."""
    order = [F.size("wrapper_chain").desc(), names.is_concrete(F.col("profile_id")).desc(), levels.rank(F.col("severity")).desc(), F.col("seq")]
    return rank.best(findings, ["file_path", "line", "symbol", "profile_id"], order)


def policed(findings: DataFrame, params: DataFrame, free: DataFrame) -> DataFrame:
    """findings under an organisation's policy: what a parameter (key_bits, mode) of the profile, else of its parents, doesn't allow gets the policy's severity if that is worse; profiles that
    the whitelist frees get `low`."""
    of = findings.withColumn("__i", F.monotonically_increasing_id())
    of = cut(of)
    parts = F.split("profile_id", r"\.")
    up = of.where("profile_id is not null").select("__i", "key_bits", "mode", F.posexplode(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("up", "key"))
    rules = params.select("key", "param", "allow", "disallow", F.col("severity").alias("__s"))
    met = up.join(resolve.small(rules), "key")
    value = F.when(F.col("param") == "key_bits", F.col("key_bits").cast("string")).when(F.col("param").isin("mode", "block_mode"), F.col("mode"))
    bad = value.isNotNull() & (((F.size("allow") > 0) & ~F.array_contains("allow", value)) | F.array_contains("disallow", value))
    own = rank.best(met, ["__i", "param"], [F.col("up")]).where(F.coalesce(bad, F.lit(False)))
    worst = own.groupBy("__i").agg(F.max_by("__s", F.struct(levels.rank(F.col("__s")), "param")).alias("__s"), F.min("param").alias("__param"))
    freed = free.select(F.col("key").alias("profile_id")).distinct().withColumn("__free", F.lit(True))
    got = of.join(worst, "__i", "left").join(resolve.small(freed), "profile_id", "left")
    worse = F.coalesce(levels.rank(F.col("__s")) > levels.rank(F.col("severity")), F.lit(False))
    severity = F.when(F.col("__free"), "low").when(worse, F.col("__s")).otherwise(F.col("severity"))
    reason = F.when(F.col("__free"), "freed by policy").when(F.col("__param").isNotNull(), F.concat(F.lit("policy: "), "__param")).otherwise(F.col("reason"))
    return got.withColumn("severity", severity).withColumn("reason", reason).select(findings.columns)


def _contract_rules(contracts: DataFrame) -> DataFrame:
    """Wrapper contracts (api_id, lang, symbol, profile_id) as rules without a size argument; they come after all others."""
    none = F.lit("none")
    return contracts.select("api_id", "lang", "symbol", "profile_id", F.lit(-1).alias("bits_arg"), F.lit("bits").alias("bits_unit"), none.alias("arg_kind"), F.lit("wrapper").alias("category"), F.lit(1 << 30).alias("ord"), F.array().cast("array<string>").alias("imports"))


def scan(spark: SparkSession, folder: str, recursive: bool = True, langs: list[str] | None = None, dims: dict[str, DataFrame] | None = None, whitelist: list[str] = (), policy: tuple[DataFrame, DataFrame] | None = None, contracts: DataFrame | None = None, skip: list[str] = (), validators: list = (), progress=None, readers: dict | None = None) -> dict[str, DataFrame]:
    """files, findings, by_file and summary of a source tree. Files that can't be read are rows with a status. policy: params and whitelist of kb.load_policy; contracts: of
    kb.load_wrappers; skip: registry.SWITCHES; validators: functions of the findings to a condition; progress(done, of, step); readers: of further languages."""
    dims = dims or knowledge.builtin(spark)
    off = registry.skipped(spark, skip)
    tell = progress or (lambda done, of, step: None)
    rules = dims["rules"] if "imports" in dims["rules"].columns else dims["rules"].withColumn("imports", F.array().cast("array<string>"))
    if contracts is not None:
        rules = rules.unionByName(_contract_rules(contracts))
    files = cut(source_files.scan(spark, folder, recursive, langs))
    tell(1, 4, "files")
    rows = cut(extract.extract(files, readers))
    f = extract.facts(rows)
    tell(2, 4, "facts")
    calls = cut(matched_calls(f["calls"], f["imports"], rules, "imports" not in off))
    direct = cut(with_initialisers(direct_findings(calls, f["assignments"]), f["calls"]))
    own = f["functions"].select("file_path", F.col("name").alias("symbol")).distinct()
    direct = direct.join(own, ["file_path", "symbol"], "left_anti")
    tell(3, 4, "matches")
    cols = ["file_path", "lang", "line", "seq", "symbol", "owner_function", "call_id", "profile_id", "key_bits", "mode", "wrapper_chain", "rule_id", "receiver"]
    every = direct.select(*cols)
    if "wrappers" not in off:
        wrapped = wrapper_findings(direct, f["calls"], f["functions"])
        every = every.unionByName(wrapped.select(*cols[:-1]), allowMissingColumns=True)
    every = rated(code.plausible_bits(cut(every)), dims, whitelist)
    if "noise" not in off:
        every = code.without_noise(every)
    if policy is not None:
        every = policed(every, *policy)
    findings = cut(registry.valid(dedup(every).select(*FINDING), validators))
    tell(4, 4, "findings")
    broken = f["errors"].select("file_path").distinct().withColumn("__bad", F.lit(True))
    status = files.join(broken, "file_path", "left").withColumn("status", F.when(F.col("__bad"), "error").otherwise(F.col("status"))).select("file_path", "lang", "size_bytes", "status")
    return {"files": status, "findings": findings, "by_file": report.by_severity(findings, ["file_path"]), "summary": report.folder_summary(status, findings), "facts": rows}
