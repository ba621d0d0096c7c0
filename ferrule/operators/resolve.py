"""Resolution against the knowledge base: rules under layer, import and whitelist conditions, map chains, nested calls, wrapper entries, derived contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear, names
from .match import suffix_join
from .rank import best

#: Rows of a dimension that may be broadcast; beyond it a join shuffles.
BROADCAST_ROWS = 250_000
# Profiles that a more specific one in the chain replaces.
GENERIC_PROFILES = ["ALG.RSA", "ALG.EC", "ALG.AES", "ALG.DES", "ALG.DSA", "ALG.DH"]


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def import_meets(imports: Column, required: Column) -> Column:
    """Whether a file with these imports meets a rule's: none required, or one that is imported, whole, by its parent package or as a dotted suffix."""
    dots = lambda c: F.transform(c, lambda x: F.replace(x, F.lit("/"), F.lit(".")))
    met = F.exists(dots(imports), lambda i: F.exists(dots(required), lambda r: (i == r) | i.startswith(F.concat(r, F.lit("."))) | i.endswith(F.concat(F.lit("."), r))))
    return F.coalesce(F.size(required) == 0, F.lit(True)) | F.coalesce(met, F.lit(False))


def precise_match(calls: DataFrame, rules: DataFrame, symbol: str = "symbol", rule: str = "rule_symbol") -> DataFrame:
    """calls (symbol, layer, imports) with each rule (rule_symbol, rule_layer, rule_imports) that meets them: one layer, an import, and the symbol itself or, if both are dotted, one a
    suffix of the other. The join is on layer and last segment; all else is a residual."""
    met = suffix_join(calls.withColumn("__l", F.col("layer")), small(rules.withColumn("__r", F.col("rule_layer"))), symbol, rule).where("__l = __r")
    dotted = F.contains(symbol, F.lit(".")) & F.contains(rule, F.lit("."))
    return met.where((F.col(symbol) == F.col(rule)) | dotted).where(import_meets(F.col("imports"), F.col("rule_imports"))).drop("__l", "__r")


def legacy_match(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """The looser rule test: a symbol pattern with * and ? over the whole symbol, or a dotted suffix; imports by suffix; an empty list meets all. Patterns are a dimension that is
    counted before it is broadcast; rules without wildcards meet their calls by the last segment."""
    wild = rules.where(F.col("rule_symbol").rlike(r"[*?]"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("rule_symbol", r"([.+^$(){}\[\]|\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    if wild.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} patterns")
    by_pattern = calls.join(F.broadcast(wild.withColumn("__re", pattern)), F.expr("symbol rlike __re")).drop("__re")
    plain = suffix_join(calls, small(rules.where(~F.col("rule_symbol").rlike(r"[*?]"))), "symbol", "rule_symbol")
    plain = plain.where((F.col("symbol") == F.col("rule_symbol")) | F.col("symbol").endswith(F.concat(F.lit("."), F.col("rule_symbol"))))
    return by_pattern.unionByName(plain).where(import_meets(F.col("imports"), F.col("rule_imports")))


def whitelisted(matches: DataFrame, apis: DataFrame, symbol: str = "symbol") -> DataFrame:
    """matches (library, symbol) whose library lists the symbol: equal, as a dotted suffix or by its tail, which either has in common. A semi-join on (library, tail)."""
    known = apis.select("library", names.last_segment(F.col("api")).alias("__t")).distinct()
    return matches.withColumn("__t", names.last_segment(F.col(symbol))).join(known, ["library", "__t"], "left_semi").drop("__t")


def rules_in_use(rules: DataFrame, used: DataFrame) -> DataFrame:
    """(file, rule columns) for the libraries that each file itself uses; used: (file_path, library)."""
    return used.select("file_path", "library").distinct().join(small(rules), "library")


def direct_or_empty(findings: DataFrame, rules: DataFrame, wrappers: DataFrame) -> DataFrame:
    """findings if there is any direct rule or wrapper, else none: the early exit as a semi-join on a constant, which Spark runs before the rest."""
    any_ = rules.select(F.lit(1).alias("__one")).limit(1).unionByName(wrappers.select(F.lit(1).alias("__one")).limit(1)).distinct()
    return findings.withColumn("__one", F.lit(1)).join(F.broadcast(any_), "__one", "left_semi").drop("__one")


def chain_is_sane(symbol: Column, chain: Column) -> Column:
    """Whether the symbol's tail is the tail of some link of its chain."""
    return F.array_contains(F.transform(chain, lambda x: names.last_segment(x)), names.last_segment(symbol))


def candidates(rows: DataFrame, types: list[str] | None = None, confidence: float | None = None) -> DataFrame:
    """Candidates of the given API types and at least the given confidence."""
    rows = rows if types is None else rows.where(F.col("api_type").isin(types))
    return rows if confidence is None else rows.where(F.col("confidence") >= confidence)


def with_profile(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("profile_id").isNotNull() & (F.col("profile_id") != ""))


def field_receivers(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """calls (class, receiver) with the type of the field that the receiver names (self.x, this.x), null if it is no known one. fields: (class, field, type), one type a field."""
    field = F.regexp_extract("receiver", r"^(?:self|this)\.(\w+)", 1)
    own = fields.select("class", F.col("field").alias("__f"), F.col("type").alias("receiver_type"))
    return calls.withColumn("__f", field).join(own, ["class", "__f"], "left").drop("__f")


def attribute_names(calls: DataFrame, attributes: DataFrame) -> DataFrame:
    """calls (call_id, line, symbol, member) with fq_symbol of the first attribute (seq) on the same line, symbol and member, else their own symbol."""
    keys = ["line", "symbol", "member"]
    first = attributes.groupBy(*keys).agg(F.min_by("fq_symbol", "seq").alias("__fq"))
    return calls.join(first, keys, "left").withColumn("fq_symbol", F.coalesce("__fq", "symbol")).drop("__fq")


def attributes_as_calls(calls: DataFrame, attributes: DataFrame) -> DataFrame:
    """Call sites with attributes behind them, as calls without arguments."""
    return calls.withColumn("pseudo", F.lit(False)).unionByName(attributes.withColumn("pseudo", F.lit(True)), allowMissingColumns=True)


def from_maps(rows: DataFrame, symbol: str, maps: list[DataFrame]) -> DataFrame:
    """rows with `found`: the value of the first hit over maps (name, value) in order, in each by the whole symbol, then by its tail. Names are unique in a map."""
    out, hits = rows.withColumn("__tail", names.function_tail(F.col(symbol))), []
    for i, m in enumerate(maps):
        for j, by in enumerate((symbol, "__tail")):
            hits.append(f"__v{i}{j}")
            out = out.join(small(m.select(F.col("name").alias(f"__n{i}{j}"), F.col("value").alias(hits[-1]))), F.col(by) == F.col(f"__n{i}{j}"), "left").drop(f"__n{i}{j}")
    return out.withColumn("found", F.coalesce(*hits)).drop("__tail", *hits)


def nested_profiles(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls (call_id, args, profile_id) whose profile isn't concrete get the first concrete one that a rule (rule_symbol, rule_profile) has for a call inside an argument."""
    inner = calls.where(~F.coalesce(names.is_concrete(F.col("profile_id")), F.lit(False))).select("call_id", F.posexplode("args").alias("at", "arg"))
    inner = inner.withColumn("__inner", F.regexp_extract("arg", r"^\s*([A-Za-z_][\w.]*)\s*\(.*\)\s*$", 1)).where("__inner <> ''")
    met = suffix_join(inner, small(rules.where(names.is_concrete(F.col("rule_profile")) & ~names.is_random(F.col("rule_profile")))), "__inner", "rule_symbol")
    first = met.groupBy("call_id").agg(F.min_by("rule_profile", F.struct("at", F.negate(F.length("rule_symbol")), "rule_symbol")).alias("__p"))
    return calls.join(first, "call_id", "left").withColumn("profile_id", F.coalesce("__p", "profile_id")).drop("__p")


def chain_profiles(findings: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """findings (key, profile_id, chain) whose profile is generic get the most dotted profile that their chain's links have (known: name, profile), the first of equals."""
    links = findings.where(F.col("profile_id").isin(GENERIC_PROFILES)).select(key, "profile_id", F.posexplode("chain").alias("at", "name"))
    met = links.join(known.where(F.col("profile").startswith("ALG.")), "name").withColumn("__d", F.size(F.split("profile", r"\.")))
    top = met.where(F.col("__d") > F.size(F.split("profile_id", r"\."))).groupBy(key).agg(F.max_by("profile", F.struct("__d", F.negate("at"), "profile")).alias("__p"))
    return findings.join(top, key, "left").withColumn("profile_id", F.coalesce("__p", "profile_id")).drop("__p")


def collapse_aliases(findings: DataFrame) -> DataFrame:
    """Of findings (file_path, line, profile_id, chain, symbol) with two links or more and one line, profile and chain of tails, the one that reads most like its call site: with . or ->,
    then with ::, then the shortest, then by name. Others stay."""
    symbol = F.col("symbol")
    tails = F.array_join(F.transform("chain", lambda x: names.function_tail(x)), ">")
    order = [F.when(symbol.contains(".") | symbol.contains("->"), 0).otherwise(1), F.when(symbol.contains("::"), 0).otherwise(1), F.length(symbol), symbol]
    several = best(findings.where(F.size("chain") > 1).withColumn("__c", tails), ["file_path", "line", "profile_id", "__c"], order).drop("__c")
    return findings.where(F.coalesce(F.size("chain") <= 1, F.lit(True))).unionByName(several)


def wrapper_entry(calls: DataFrame, entries: DataFrame, imported: DataFrame) -> DataFrame:
    """calls (call_id, file_path, symbol) with one entry (name, library, profile_id, ord) of their name, in any case: of a library that the file imports, else of none, else the first."""
    low = lambda c: F.lower(F.trim(c))
    met = calls.withColumn("__n", F.lower("symbol")).join(entries.withColumn("__n", F.lower("name")).withColumn("__lib", F.nullif(low(F.coalesce("library", F.lit(""))), F.lit(""))), "__n")
    have = imported.select("file_path", low(F.col("library")).alias("__lib")).distinct().withColumn("__have", F.lit(True))
    met = met.join(have, ["file_path", "__lib"], "left")
    tier = F.when(F.col("__have"), 1).when(F.col("__lib").isNull(), 2).otherwise(3)
    return best(met.withColumn("tier", tier), ["call_id"], [F.col("tier"), F.col("ord")]).drop("__n", "__lib", "__have")


def contracts_of(effects: DataFrame, constraints: DataFrame) -> DataFrame:
    """Bounds on wrappers' parameters: effects (name, field, param, mul, div, add: what reaches the sink) with constraints (field, min, pq_min) turned back through the transform, and of a
    parameter's bounds the strictest."""
    met = effects.join(small(constraints), "field").withColumn("__t", F.coalesce("pq_min", "min"))
    bound = linear.reverse_bound(F.lit("GEQ"), F.col("__t"), F.col("mul"), F.col("add"), F.col("div"))
    return met.withColumn("value", bound).where("value is not null").groupBy("name", "param").agg(F.max("value").alias("value"), F.count("*").alias("merged")).withColumn("predicate", F.lit("GEQ"))


def summary_of(findings: DataFrame, key: list[str]) -> DataFrame:
    """(key, entry functions, algorithms, affected): different entry functions, profiles and functions of the findings."""
    return findings.groupBy(*key).agg(F.count_distinct("entry").alias("entries"), F.count_distinct("profile_id").alias("algorithms"), F.count_distinct("owner_function").alias("affected"))


def finding_text(symbol: Column, file: Column, line: Column, confidence: Column) -> Column:
    """One line of text for a candidate."""
    return F.format_string("Candidate(%s at %s:%d, confidence=%.2f)", symbol, file, line.cast("long"), confidence.cast("double"))


def rules_of_bindings(bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """Language bindings (rule_id, ...) with the common rule they name; what names no rule is dropped."""
    own = [c for c in rules.columns if c == "rule_id" or c not in bindings.columns]
    return bindings.join(small(rules.select(*own)), "rule_id")


def split_constraints(profiles: DataFrame, key: str = "profile_id", constraints: str = "quantum_constraints") -> DataFrame:
    """(profile, parameter, kind, minimum) of profiles whose constraints are a JSON object of parameter -> object: `inherent` if min_pq_resistant is null (no size helps), `numeric` if it is a
    number above 0, `none` if it is absent."""
    params = profiles.select(key, F.explode(F.from_json(constraints, "map<string,map<string,string>>")).alias("param", "c"))
    least = F.try_element_at("c", F.lit("min_pq_resistant"))
    number = least.try_cast("double")
    kind = F.when(~F.map_contains_key("c", "min_pq_resistant"), "none").when(least.isNull(), "inherent").when(number > 0, "numeric").otherwise("none")
    return params.select(key, "param", kind.alias("kind"), F.when(kind == "numeric", number.cast("long")).alias("minimum"), F.try_element_at("c", F.lit("reason")).alias("reason"))


def legacy_fields(rules: DataFrame, semantic: str = "semantic") -> DataFrame:
    """rules with the older names of what their semantic (struct of key_bits: source, param, bits_param, length_param) says: from_param, key_bits_param, bytes_param."""
    k = F.col(semantic)["key_bits"]
    named = F.when(k["source"] == "param", k["param"])
    return rules.withColumns({"from_param": named, "key_bits_param": F.coalesce(named, k["bits_param"]), "bytes_param": k["length_param"]})


def deep_fill(first: Column, second: Column) -> Column:
    """A map filled from another, key by key: the first's value if it is neither null nor empty."""
    return F.map_zip_with(first, second, lambda _, a, b: F.when(a.isNull() | (a == ""), b).otherwise(a))


