"""Operators of `resolve` and paths of `graph`, bound to the driver's tables. They add to the queries of `bound`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, resolve
from .bound import _EDGES, _edges, _sinks, _tree, long, query, read

_PART = "p AS (SELECT p_partkey, p_type AS layer, 'lib.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS symbol, ['lib.' || replace(p_brand, '#', '') || '.x', 'mod' || (p_size % 4)] AS imports FROM part)"
_RULES = "r AS (SELECT DISTINCT replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS rule_symbol, p_type AS rule_layer, CASE WHEN p_size % 2 = 0 THEN ['lib.' || replace(p_brand, '#', '')] ELSE ['mod1', 'other'] END AS rule_imports FROM part WHERE p_size <= 20)"
_MEETS = "(len(rule_imports) = 0 OR len(list_filter(imports, lambda i: len(list_filter(rule_imports, lambda x: i = x OR starts_with(i, x || '.') OR starts_with(i, x || '/') OR ends_with(i, '.' || x))) > 0)) > 0)"


def _plain(c, old, new):
    return F.replace(c, F.lit(old), F.lit(new))


def _calls(spark, sf_dir):
    brand = _plain("p_brand", "#", "")
    symbol = F.concat(F.lit("lib."), brand, F.lit("."), _plain("p_name", " ", "_"))
    imports = F.array(F.concat(F.lit("lib."), brand, F.lit(".x")), F.concat(F.lit("mod"), (F.col("p_size") % 4).cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("layer"), symbol.alias("symbol"), imports.alias("imports"))


def _rules(spark, sf_dir):
    brand = _plain("p_brand", "#", "")
    imports = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit("lib."), brand))).otherwise(F.array(F.lit("mod1"), F.lit("other")))
    return read(spark, sf_dir, "part").where("p_size <= 20").select(F.concat_ws(".", brand, _plain("p_name", " ", "_")).alias("rule_symbol"), F.col("p_type").alias("rule_layer"), imports.alias("rule_imports")).distinct()


@query(f"""WITH {_PART}, {_RULES} SELECT p_partkey, rule_symbol, rule_imports[1] AS first_import FROM p, r WHERE layer = rule_layer AND {_MEETS}
AND (symbol = rule_symbol OR ends_with(symbol, '.' || rule_symbol) OR ends_with(rule_symbol, '.' || symbol))""")
def q_rule_match(spark, sf_dir):
    return resolve.precise_match(_calls(spark, sf_dir), _rules(spark, sf_dir)).select("p_partkey", "rule_symbol", F.get("rule_imports", F.lit(0)).alias("first_import"))


@query(f"""WITH {_PART}, r(rule_symbol, rule_imports) AS (VALUES ('lib.Brand1?.cold*', []::VARCHAR[]), ('*widget', ['mod1']), ('hot_widget', ['lib.Brand11', 'mod2']), ('Brand13.cold_widget', []::VARCHAR[]), ('*[x]*', []::VARCHAR[]))
SELECT p_partkey, rule_symbol FROM p, r WHERE {_MEETS} AND CASE WHEN contains(rule_symbol, '*') OR contains(rule_symbol, '?') THEN symbol GLOB replace(rule_symbol, '[x]', '[[]x]') ELSE symbol = rule_symbol OR ends_with(symbol, '.' || rule_symbol) END""")
def q_legacy_match(spark, sf_dir):
    rows = [("lib.Brand1?.cold*", []), ("*widget", ["mod1"]), ("hot_widget", ["lib.Brand11", "mod2"]), ("Brand13.cold_widget", []), ("*[x]*", [])]
    rules = spark.createDataFrame(rows, "rule_symbol string, rule_imports array<string>")
    return resolve.legacy_match(_calls(spark, sf_dir), rules).select("p_partkey", "rule_symbol")


@query("""SELECT p_partkey FROM part WHERE (p_type, p_name) IN (SELECT p_type, p_name FROM part WHERE p_size <= 3)""")
def q_api_whitelist(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    apis = part.where("p_size <= 3").select(F.col("p_type").alias("library"), _plain("p_name", " ", "_").alias("api"))
    return resolve.whitelisted(_calls(spark, sf_dir).withColumnRenamed("layer", "library"), apis).select("p_partkey")


@query("""SELECT DISTINCT c_custkey, p_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_type = 'ECONOMY' AND p_size < 5""")
def q_rules_in_use(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    used = lines.select(F.col("o_custkey").alias("file_path"), F.col("l_partkey").alias("library"))
    rules = read(spark, sf_dir, "part").where("p_type = 'ECONOMY' and p_size < 5").select(F.col("p_partkey").alias("library"), "p_name")
    return resolve.rules_in_use(rules, used).select(F.col("file_path").alias("c_custkey"), "p_name").distinct()


@query("""SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND value >= 50 AND (SELECT count(*) FROM part WHERE p_size <= 10) + (SELECT count(*) FROM supplier) > 0""")
def q_candidates(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("api_type"), F.col("value").alias("confidence"))
    found = resolve.candidates(rows, ["error", "purchase"], 50)
    return resolve.direct_or_empty(found, read(spark, sf_dir, "part").where("p_size <= 10"), read(spark, sf_dir, "supplier")).select("event_id")


@query("""SELECT p_partkey, p_size % 3 = 0 AS sane FROM part""")
def q_chain_sanity(spark, sf_dir):
    chain = F.array(F.lit("outer"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("x.y."), "p_name")).otherwise(F.concat("p_name", F.lit("_other"))))
    return read(spark, sf_dir, "part").select("p_partkey", resolve.chain_is_sane(F.concat(F.lit("lib."), "p_name"), chain).alias("sane"))


@query("""SELECT event_id, event_type FROM events WHERE value >= 10""")
def q_with_profile(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("profile_id", F.when(F.col("value") >= 10, F.col("event_type")).when(F.col("value") >= 5, ""))
    return resolve.with_profile(rows).select("event_id", "event_type")


@query("""SELECT event_id, f.v AS receiver_type FROM events LEFT JOIN (SELECT user_id, event_type, arg_min(props, event_id) AS v FROM events WHERE event_type <> 'view' GROUP BY 1, 2) f USING (user_id, event_type)""")
def q_field_receivers(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    fields = e.where("event_type <> 'view'").groupBy(F.col("user_id").alias("class"), F.col("event_type").alias("field")).agg(F.min_by("props", "event_id").alias("type"))
    calls = e.select("event_id", F.col("user_id").alias("class"), F.concat(F.lit("self."), "event_type", F.lit(".update")).alias("receiver"))
    return resolve.field_receivers(calls, fields).select("event_id", "receiver_type")


@query("""WITH a AS (SELECT user_id, event_type, ts::DATE AS day, arg_min('lib.' || event_id, event_id) AS fq FROM events WHERE value > 100 GROUP BY 1, 2, 3)
SELECT event_id, coalesce(fq, e.user_id::VARCHAR) AS fq_symbol FROM events e LEFT JOIN a ON a.user_id = e.user_id AND a.event_type = e.event_type AND a.day = e.ts::DATE""")
def q_attribute_names(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("line"), F.col("user_id").cast("string").alias("symbol"), F.col("event_type").alias("member"), "value")
    attributes = e.where("value > 100").select("line", "symbol", "member", F.concat(F.lit("lib."), F.col("event_id").cast("string")).alias("fq_symbol"), F.col("event_id").alias("seq"))
    return resolve.attribute_names(e, attributes).select("event_id", "fq_symbol")


@query("""SELECT pseudo, count(*) AS n, sum(id)::BIGINT AS total FROM (SELECT false AS pseudo, event_id AS id FROM events WHERE event_type = 'click' UNION ALL SELECT true, event_id FROM events WHERE event_type <> 'click') GROUP BY 1""")
def q_attributes_as_calls(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    both = resolve.attributes_as_calls(e.where("event_type = 'click'").select("event_id", F.array("props").alias("args")), e.where("event_type <> 'click'").select("event_id"))
    return both.groupBy("pseudo").agg(F.count("*").alias("n"), long(F.sum("event_id")).alias("total"))


@query("""WITH l AS (SELECT DISTINCT 'lib.Brand13.' || p_name AS name, 'whole' AS v FROM part WHERE p_size < 10), t AS (SELECT DISTINCT p_name AS name, 'tail' AS v FROM part WHERE p_size > 48), c AS (SELECT p_name AS name, min(p_type) AS v FROM part GROUP BY 1)
SELECT p_partkey, coalesce(l.v, t.v, c.v) AS found FROM part p LEFT JOIN l ON l.name = 'lib.' || replace(p_brand, '#', '') || '.' || p_name LEFT JOIN t ON t.name = p.p_name LEFT JOIN c ON c.name = p.p_name""")
def q_map_chain(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    whole = part.where("p_size < 10").select(F.concat(F.lit("lib.Brand13."), "p_name").alias("name"), F.lit("whole").alias("value"))
    local = whole.unionByName(part.where("p_size > 48").select(F.col("p_name").alias("name"), F.lit("tail").alias("value"))).distinct()
    cross = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_type").alias("value"))
    rows = part.select("p_partkey", F.concat(F.lit("lib."), _plain("p_brand", "#", ""), F.lit("."), "p_name").alias("symbol"))
    return resolve.from_maps(rows, "symbol", [local, cross]).select("p_partkey", "found")


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'ALG.RSA.PKE' WHEN p_size % 4 = 2 THEN 'ALG.AES.GCM' WHEN p_size % 4 = 1 THEN 'ALG.MD5.X' ELSE 'UTIL.CIPHER' END AS profile_id FROM part""")
def q_nested_calls(spark, sf_dir):
    i, size = F.col("p_size") % 4, F.col("p_size").cast("string")
    args = F.array(F.concat(F.lit("n + "), size), F.when(i == 2, F.concat(F.lit("lib.gcm("), size, F.lit(")"))).when(i == 1, F.concat(F.lit("md5( f("), size, F.lit(") )"))).otherwise(F.concat(F.lit("unknown("), size, F.lit(")"))))
    calls = read(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("call_id"), args.alias("args"), F.when(i == 3, "ALG.RSA.PKE").otherwise("UTIL.CIPHER").alias("profile_id"))
    rules = spark.createDataFrame([("gcm", "ALG.AES.GCM"), ("md5", "ALG.MD5.X"), ("unknown", "UTIL.CIPHER")], "rule_symbol string, rule_profile string")
    return resolve.nested_profiles(calls, rules).select("p_partkey", "profile_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'ALG.HASH' ELSE coalesce(x, 'ALG.RSA') END AS profile_id FROM orders LEFT JOIN (
SELECT l_orderkey, arg_max('ALG.RSA' || repeat('.P', 1 + l_suppkey % 3), (l_suppkey % 3, -l_suppkey)) AS x FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey""")
def q_chain_profiles(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("chain"))
    rows = read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, "ALG.HASH").otherwise("ALG.RSA").alias("profile_id"), "chain")
    known = read(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("name"), F.concat(F.lit("ALG.RSA"), F.expr("repeat('.P', cast(1 + s_suppkey % 3 as int))")).alias("profile"))
    return resolve.chain_profiles(rows, known, "o_orderkey").select("o_orderkey", "profile_id")


@query("""WITH f AS (SELECT event_id, user_id, event_type, ts::DATE AS day, CASE event_id % 3 WHEN 0 THEN 'Key::Private::' || event_type WHEN 1 THEN '_p.' || event_type ELSE event_type END AS symbol FROM events)
SELECT user_id, event_type, day::VARCHAR AS day, symbol FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY CASE WHEN contains(symbol, '.') OR contains(symbol, '->') THEN 0 ELSE 1 END, CASE WHEN contains(symbol, '::') THEN 0 ELSE 1 END, length(symbol), symbol) AS r FROM f) WHERE r = 1 OR event_type = 'view'""")
def q_alias_collapse(spark, sf_dir):
    kind = F.col("event_id") % 3
    symbol = F.when(kind == 0, F.concat(F.lit("Key::Private::"), "event_type")).when(kind == 1, F.concat(F.lit("_p."), "event_type")).otherwise(F.col("event_type"))
    chain = F.when(F.col("event_type") == "view", F.array("event_type")).otherwise(F.array(F.lit("lib.inner"), symbol))
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("file_path"), F.to_date("ts").alias("line"), F.col("event_type").alias("profile_id"), chain.alias("chain"), symbol.alias("symbol"))
    rows = rows.withColumn("chain", F.transform("chain", lambda x: F.regexp_replace(x, "^(Key::Private::|_p\\\\.)", "")))
    out = resolve.collapse_aliases(rows)
    return out.select(F.col("file_path").alias("user_id"), F.col("profile_id").alias("event_type"), F.col("line").cast("string").alias("day"), "symbol")


@query("""WITH e(name, library, profile_id, ord) AS (VALUES ('Furniture', 'NATION_1', 'A', 0), ('furniture', ' nation_2 ', 'B', 1), ('FURNITURE', '', 'C', 2), ('building', 'NATION_3', 'D', 3), ('building', 'NATION_4', 'E', 4))
SELECT c_custkey, profile_id FROM (SELECT c_custkey, profile_id, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN lower(trim(library)) = 'nation_' || c_nationkey THEN 1 WHEN library = '' THEN 2 ELSE 3 END, ord) AS r FROM customer JOIN e ON lower(name) = lower(c_mktsegment)) WHERE r = 1""")
def q_wrapper_entry(spark, sf_dir):
    entries = spark.createDataFrame([("Furniture", "NATION_1", "A", 0), ("furniture", " nation_2 ", "B", 1), ("FURNITURE", "", "C", 2), ("building", "NATION_3", "D", 3), ("building", "NATION_4", "E", 4)], "name string, library string, profile_id string, ord int")
    c = read(spark, sf_dir, "customer")
    calls = c.select("c_custkey", F.col("c_custkey").alias("call_id"), F.col("c_nationkey").alias("file_path"), F.col("c_mktsegment").alias("symbol"))
    imported = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file_path"), F.col("n_name").alias("library"))
    return resolve.wrapper_entry(calls, entries, imported).select("c_custkey", "profile_id")


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 3072 ELSE 256 END AS t, (1 + l_suppkey % 8) AS mul, (l_partkey % 16) AS a FROM lineitem)
SELECT l_orderkey, l_linenumber, max(ceil((t - a) / mul::DOUBLE))::BIGINT AS value, count(*) AS merged FROM m GROUP BY 1, 2""")
def q_derive_contracts(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem")
    effects = lines.select(F.col("l_orderkey").alias("name"), F.col("l_linenumber").alias("param"), F.when(F.col("l_returnflag") == "R", "modulus").otherwise("key").alias("field"), (1 + F.col("l_suppkey") % 8).alias("mul"), F.lit(1).cast("long").alias("div"), (F.col("l_partkey") % 16).alias("add"))
    limits = spark.createDataFrame([("modulus", 2048, 3072), ("key", 256, None)], "field string, min long, pq_min long")
    return resolve.contracts_of(effects, limits).select(F.col("name").alias("l_orderkey"), F.col("param").alias("l_linenumber"), "value", "merged")


@query("""SELECT user_id, count(DISTINCT event_type) AS entries, count(DISTINCT props) AS algorithms, count(DISTINCT ts::DATE) AS affected FROM events GROUP BY 1""")
def q_function_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("entry"), F.col("props").alias("profile_id"), F.to_date("ts").alias("owner_function"))
    return resolve.summary_of(rows, ["user_id"])


@query("""SELECT event_id, 'Candidate(' || event_type || ' at user' || user_id || ':' || event_id || ', confidence=' || printf('%.2f', value) || ')' AS text FROM events""")
def q_finding_text(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", resolve.finding_text(F.col("event_type"), F.concat(F.lit("user"), F.col("user_id").cast("string")), F.col("event_id"), F.col("value")).alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_type FROM lineitem JOIN part ON p_partkey = l_partkey""")
def q_rule_bindings(spark, sf_dir):
    bindings = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("rule_id"))
    rules = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), "p_name", "p_type")
    return resolve.rules_of_bindings(bindings, rules).select("l_orderkey", "l_linenumber", F.col("rule_id").alias("l_partkey"), "p_name", "p_type")


@query("""SELECT p_partkey, 'key_bits' AS param, CASE p_size % 4 WHEN 0 THEN 'inherent' WHEN 1 THEN 'numeric' ELSE 'none' END AS kind, CASE WHEN p_size % 4 = 1 THEN p_size * 64::BIGINT END AS minimum FROM part""")
def q_constraint_split(spark, sf_dir):
    i, size = F.col("p_size") % 4, (F.col("p_size") * 64).cast("string")
    least = F.when(i == 0, '"min_pq_resistant": null, ').when(i == 1, F.concat(F.lit('"min_pq_resistant": '), size, F.lit(", "))).when(i == 2, '"min_pq_resistant": 0, ').otherwise("")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit('{"key_bits": {'), least, F.lit('"reason": "r"}}')).alias("quantum_constraints"))
    return resolve.split_constraints(rows, "p_partkey").select("p_partkey", "param", "kind", "minimum")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name END AS from_param, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS key_bits_param, p_type AS bytes_param FROM part""")
def q_legacy_fields(spark, sf_dir):
    k = F.struct(F.when(F.col("p_size") % 2 == 0, "param").otherwise("return").alias("source"), F.col("p_name").alias("param"), F.col("p_brand").alias("bits_param"), F.col("p_type").alias("length_param"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.struct(k.alias("key_bits")).alias("semantic"))
    return resolve.legacy_fields(rows).select("p_partkey", "from_param", "key_bits_param", "bytes_param")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE p_name END AS a, p_brand AS b, p_type AS c FROM part""")
def q_deep_fill(spark, sf_dir):
    first = F.create_map(F.lit("a"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_name")), F.lit("b"), F.col("p_brand"))
    second = F.create_map(F.lit("a"), F.col("p_type"), F.lit("b"), F.col("p_name"), F.lit("c"), F.col("p_type"))
    m = resolve.deep_fill(first, second)
    return read(spark, sf_dir, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query(f"""{_EDGES}, w(root, node, path, depth) AS (SELECT node, node, node::VARCHAR, 0 FROM roots UNION ALL SELECT root, node, path, depth FROM (
SELECT w.root, e.dst AS node, min(w.path || '>' || e.dst) AS path, w.depth + 1 AS depth FROM w JOIN edges e ON e.src = w.node WHERE w.depth < 3 GROUP BY 1, 2, 4)),
f AS (SELECT root, node, arg_min(path, (depth, path)) AS path, min(depth) AS depth FROM w GROUP BY 1, 2),
k AS (SELECT node, path, row_number() OVER (PARTITION BY node ORDER BY depth, path) AS r FROM f WHERE node[1] = 'n') SELECT node AS via, path FROM k WHERE r <= 2""")
def q_prefix_paths(spark, sf_dir):
    vias = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return graph.prefixes(_edges(spark, sf_dir), vias, 2, 3).select("via", F.array_join("path", ">").alias("path"))


@query(f"""{_EDGES}, w(path, node, depth) AS (SELECT [node], node, 0 FROM roots UNION ALL SELECT list_append(path, dst), dst, depth + 1 FROM w JOIN edges ON src = node WHERE NOT list_contains(path, dst) AND depth < 3)
SELECT node AS target, count(*) AS paths, min(array_to_string(path, '>')) AS least FROM w WHERE node[1] = 'r' GROUP BY 1""")
def q_simple_paths(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    paths = graph.simple_paths(edges, graph.roots(edges), _sinks(spark, sf_dir), 3)
    return paths.groupBy("target").agg(F.count("*").alias("paths"), F.min(F.array_join("path", ">")).alias("least"))


@query("""SELECT 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey AS path FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_tree_paths(spark, sf_dir):
    tree, regions = _tree(spark, sf_dir), _sinks(spark, sf_dir)
    leaves = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.simple_paths(tree, regions, leaves, 4).select(F.array_join("path", ">").alias("path"))
