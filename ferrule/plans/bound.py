"""Every operator bound to the driver's tables, with the SQL that says the same. Names and types of columns agree on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algorithms, bits, levels, linear, names
from ..operators import asof, code, constraint, graph, interval, match, rank, report, state
from ..sources import files as source_files
from ..sources.shared import cut
from . import wrappers

#: Rows of a table that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 250_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# ---- scans and projections ----


@query("""SELECT lang, CASE WHEN n_chars > 5000 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n, sum(n_chars)::BIGINT AS chars
FROM documents WHERE lang IN ('en', 'de', 'fr') GROUP BY 1, 2""")
def q_scan_guard(spark, sf_dir):
    docs = source_files.guard(read(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de", "fr")), "n_chars", 5000)
    return docs.groupBy("lang", "status").agg(F.count("*").alias("n"), long(F.sum("n_chars")).alias("chars"))


@query("""SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'other' END AS language, count(*) AS n FROM documents GROUP BY 1""")
def q_lang_dim(spark, sf_dir):
    dim = {"en": "English", "de": "German", "fr": "French"}
    return read(spark, sf_dir, "documents").groupBy(F.coalesce(source_files.dimension(F.col("lang"), dim), F.lit("other")).alias("language")).agg(F.count("*").alias("n"))


_PATHS = "replace(p_type, ' ', '_') || '.' || replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_')"


@query(f"""WITH p AS (SELECT p_partkey, {_PATHS} AS path FROM part), r AS (SELECT DISTINCT replace(p_brand, '#', '') || '.' || replace(p_name, ' ', '_') AS rule FROM part WHERE p_size <= 10)
SELECT p_partkey, rule FROM p, r WHERE path = rule OR ends_with(path, '.' || rule) OR ends_with(rule, '.' || path)""")
def q_suffix_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    brand, name = F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_"))
    paths = part.select("p_partkey", F.concat_ws(".", F.replace("p_type", F.lit(" "), F.lit("_")), brand, name).alias("path"))
    rules = part.where("p_size <= 10").select(F.concat_ws(".", brand, name).alias("rule")).distinct()
    return match.suffix_join(paths, rules, "path", "rule").select("p_partkey", "rule")


@query(f"""WITH p AS (SELECT {_PATHS} AS path FROM part) SELECT variant, count(*) AS n FROM (
SELECT unnest(list_distinct([path, array_to_string(list_slice(string_split(path, '.'), -2, -1), '.'), string_split(path, '.')[-1], string_split(path, '.')[1]])) AS variant FROM p) GROUP BY 1 HAVING count(*) > 20""")
def q_symbol_variants(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    path = F.concat_ws(".", F.replace("p_type", F.lit(" "), F.lit("_")), F.replace("p_brand", F.lit("#"), F.lit("")), F.replace("p_name", F.lit(" "), F.lit("_")))
    return part.select(F.explode(names.symbol_variants(path)).alias("variant")).groupBy("variant").agg(F.count("*").alias("n")).where("n > 20")


@query("""SELECT doc_id, count(*) AS tokens, sum(t::BIGINT)::BIGINT AS total FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(\\d{1,6})\\b', 1)) AS t FROM documents) GROUP BY 1""")
def q_ints_from_text(spark, sf_dir):
    found = read(spark, sf_dir, "documents").select("doc_id", F.explode(names.integers(F.col("text"))).alias("t"))
    return found.groupBy("doc_id").agg(F.count("*").alias("tokens"), long(F.sum("t")).alias("total"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1)))::BIGINT AS identifiers FROM documents""")
def q_regex_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", long(F.size(names.identifiers(F.col("text")))).alias("identifiers"))


@query("""SELECT doc_id, count(*) AS lines, max(length(l))::BIGINT AS longest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1""")
def q_line_explode(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "l"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), long(F.max(F.length("l"))).alias("longest"))


@query("""SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages) GROUP BY 1, 2""")
def q_html_links(spark, sf_dir):
    links = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query("""SELECT event_type, (json_extract(props, '$.k')::BIGINT // 10) AS bucket, count(*) AS n FROM events GROUP BY 1, 2""")
def q_json_semantic(spark, sf_dir):
    k = code.json_field(F.col("props"), "k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type", F.floor(k / 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT label::BIGINT AS label, count(*) AS n, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS norm FROM embeddings GROUP BY 1""")
def q_vec_label(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return read(spark, sf_dir, "embeddings").groupBy(long("label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(norm), 4).alias("norm"))


# ---- matching and joins ----


@query("""WITH cand AS (SELECT c_custkey, s.segment AS answer, (CASE WHEN c_mktsegment = s.segment THEN 200 ELSE 0 END) + (CASE WHEN c_acctbal > s.floor THEN 80 ELSE 0 END) AS score
FROM customer, (VALUES ('BUILDING', 0.0), ('MACHINERY', 5000.0), ('AUTOMOBILE', 8000.0)) AS s(segment, floor)),
top AS (SELECT c_custkey, answer, score, rank() OVER (PARTITION BY c_custkey ORDER BY score DESC) AS r FROM cand)
SELECT c_custkey, CASE WHEN min(answer) = max(answer) THEN min(answer) END AS answer, max(score)::BIGINT AS score, count(*) AS candidates FROM top WHERE r = 1 GROUP BY 1""")
def q_best_rule(spark, sf_dir):
    rules = spark.createDataFrame([("BUILDING", 0.0), ("MACHINERY", 5000.0), ("AUTOMOBILE", 8000.0)], "answer string, floor double")
    rows = read(spark, sf_dir, "customer").crossJoin(F.broadcast(rules))
    score = F.when(F.col("c_mktsegment") == F.col("answer"), 200).otherwise(0) + F.when(F.col("c_acctbal") > F.col("floor"), 80).otherwise(0)
    return rank.best_or_null(rows, ["c_custkey"], score, "answer", F.col("answer")).select("c_custkey", "answer", long("score").alias("score"), "candidates")


@query("""WITH p(key, allow) AS (VALUES ('NATION_3', '3000'), ('REGION_1', '2048'), ('REGION_2', '4096'))
SELECT s_suppkey, coalesce(a.allow, b.allow) AS allow, s_nationkey IN (5, 7) AS whitelisted FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN p a ON a.key = 'NATION_' || n_nationkey LEFT JOIN p b ON b.key = 'REGION_' || n_regionkey""")
def q_policy_override(spark, sf_dir):
    params = spark.createDataFrame([("NATION_3", "3000"), ("REGION_1", "2048"), ("REGION_2", "4096")], "key string, allow string")
    free = spark.createDataFrame([("NATION_5",), ("NATION_7",)], "key string")
    rules = read(spark, sf_dir, "supplier").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rules = rules.select("s_suppkey", F.concat(F.lit("NATION_"), "n_nationkey").alias("rule"), F.concat(F.lit("REGION_"), "n_regionkey").alias("fam"))
    return match.apply_policy(rules, params, free, "rule", "fam").select("s_suppkey", "allow", "whitelisted")


@query("""WITH known(p) AS (VALUES ('ALG.RSA.PKE'), ('ALG.AES'), ('ALG.HASH')), al(a, t) AS (VALUES ('ALG.SHA', 'ALG.HASH')),
x AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'ALG.RSA' WHEN 1 THEN 'ALG.AES.GCM' WHEN 2 THEN 'ALG.SHA' WHEN 3 THEN 'ALG.DSA' ELSE 'ALG.AES' END AS profile FROM part),
y AS (SELECT p_partkey, profile, CASE WHEN profile = 'ALG.RSA' THEN 'ALG.RSA.PKE' WHEN profile = 'ALG.DSA' THEN 'ALG.DSA.SIG' ELSE profile END AS c, regexp_replace(profile, '\\.[^.]*$', '') AS parent FROM x)
SELECT p_partkey, profile, coalesce((SELECT p FROM known WHERE p = coalesce((SELECT t FROM al WHERE a = c), c)), (SELECT p FROM known WHERE p = coalesce((SELECT t FROM al WHERE a = profile), profile)),
(SELECT p FROM known WHERE p = coalesce((SELECT t FROM al WHERE a = parent), parent)), 'ALG.DYNAMIC') AS resolved_profile FROM y""")
def q_kb_merge(spark, sf_dir):
    profile = F.element_at(F.array(*[F.lit(x) for x in ("ALG.RSA", "ALG.AES.GCM", "ALG.SHA", "ALG.DSA", "ALG.AES")]), F.col("p_size") % 5 + 1)
    apis = read(spark, sf_dir, "part").select("p_partkey", profile.alias("profile"))
    known = spark.createDataFrame([("ALG.RSA.PKE",), ("ALG.AES",), ("ALG.HASH",)], "profile_id string")
    aliases = spark.createDataFrame([("ALG.SHA", "ALG.HASH")], "alias string, profile_id string")
    got = match.merge_kb(apis, known, aliases, "profile", algorithms.classify_public_key(F.col("profile"), F.lit("generateKey")))
    return got.select("p_partkey", "profile", "resolved_profile")


@query("""SELECT o_custkey AS c_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def q_relational_division(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    return match.covering(orders, orders, "c_custkey", "o_orderpriority")


@query("""WITH d AS (SELECT doc_id, CASE WHEN contains(text, 'license') OR contains(text, 'License') THEN 1 WHEN contains(text, 'copyright') OR contains(text, 'Copyright') THEN 2 WHEN n_chars > 2000 THEN 3 END AS tier FROM documents)
SELECT tier::BIGINT AS tier, count(*) AS n FROM d WHERE tier IS NOT NULL GROUP BY 1""")
def q_match_tiers(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    tiers = [docs.where(F.col("text").rlike("[lL]icense")).select("doc_id"), docs.where(F.col("text").rlike("[cC]opyright")).select("doc_id"), docs.where("n_chars > 2000").select("doc_id")]
    return match.first_tier(tiers, ["doc_id"], [F.col("doc_id")]).groupBy(long("tier").alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, 'customer' AS source FROM customer WHERE c_acctbal > 9000 UNION ALL
SELECT DISTINCT o_custkey, 'orders' FROM orders WHERE o_totalprice > 300000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def q_wrapper_merge(spark, sf_dir):
    apis = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", F.lit("customer").alias("source"))
    wrappers = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), F.lit("orders").alias("source")).distinct()
    return match.merge_wrappers(apis, wrappers, "c_custkey", "api_first")


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def q_contamination(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    # words strictly inside an item, five at most, are a key that text and item share wherever the item lies in the text
    words = lambda c: F.split(c, r"\s+")
    inner = lambda n: lambda i: F.xxhash64(F.lit(n), *[F.get(F.col("w"), i + j) for j in range(1, n + 1)])
    items = items.where("item is not null").withColumn("w", words(F.col("item"))).withColumn("n", F.greatest(F.least(F.size("w") - 2, F.lit(5)), F.lit(0)))
    few = items.count() <= BROADCAST_ROWS
    small = lambda df: F.broadcast(df) if few else df
    sizes = sorted(r["n"] for r in items.select("n").distinct().collect())
    # an item of one or two words has none inside: every text is searched for it
    out = docs.join(small(items.where("n = 0").select("item_id", "item")), F.contains("text", "item")).select("doc_id", "item_id") if 0 in sizes else None
    sizes = [n for n in sizes if n]
    if sizes or out is None:
        h = F.lit(None).cast("long")
        for n in sizes:
            h = F.when(F.col("n") == n, inner(n)(F.lit(0))).otherwise(h)
        keyed = items.where("n > 0").select("item_id", "item", h.alias("h"))
        spread = [F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n - 1, F.lit(0))), inner(n)) for n in sizes or [5]]
        at = docs.withColumn("w", words(F.col("text"))).withColumn("h", F.explode(F.array_distinct(F.concat(*spread))))
        keyed = at.join(small(keyed), "h").where(F.contains("text", "item")).select("doc_id", "item_id")
        out = keyed if out is None else out.unionByName(keyed)
    return out.distinct()


# ---- intervals and as-of ----

_EV = "floor(epoch(ts))::BIGINT AS sec"


@query(f"""WITH e AS (SELECT event_id, user_id, {_EV} FROM events), s AS (SELECT user_id, sec // 86400 AS day, min(sec) AS lo, max(sec) AS hi FROM e GROUP BY 1, 2)
SELECT event_id, e.user_id, max(day)::BIGINT AS day FROM e JOIN s ON e.user_id = s.user_id AND sec BETWEEN lo AND hi GROUP BY 1, 2""")
def q_interval_owner(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"))
    spans = e.groupBy("user_id", F.floor(F.col("at") / 86400).alias("day")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    return interval.owner(e, spans, ["user_id"], ["event_id"], "at", "lo", "hi", 86400, "last", "day").select("event_id", "user_id", "day")


@query(f"""WITH e AS (SELECT event_id, {_EV} FROM events), s AS (
SELECT 'week' AS kind, (sec // 604800) * 604800 AS lo, (sec // 604800) * 604800 + 604799 AS hi FROM e UNION SELECT 'day', (sec // 86400) * 86400, (sec // 86400) * 86400 + 86399 FROM e
UNION SELECT 'hour', (sec // 3600) * 3600, (sec // 3600) * 3600 + 3599 FROM e WHERE (sec // 3600) % 2 = 0),
m AS (SELECT event_id, kind, row_number() OVER (PARTITION BY event_id ORDER BY hi - lo, lo DESC) AS r FROM e JOIN s ON sec BETWEEN lo AND hi)
SELECT kind, count(*) AS n FROM m WHERE r = 1 GROUP BY 1""")
def q_interval_innermost(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("at"), F.lit(0).alias("file"))
    span = lambda kind, w: e.select(F.lit(0).alias("file"), F.lit(kind).alias("kind"), (F.floor(F.col("at") / w) * w).alias("lo"), (F.floor(F.col("at") / w) * w + w - 1).alias("hi")).distinct()
    spans = span("week", 604800).unionByName(span("day", 86400)).unionByName(span("hour", 3600).where(F.floor(F.col("lo") / 3600) % 2 == 0))
    return interval.owner(e, spans, ["file"], ["event_id"], "at", "lo", "hi", 86400, "innermost", "lo").groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_EV} FROM events), m AS (
SELECT a.event_id, b.event_id AS near_id, (a.user_id = b.user_id) AS same_user, row_number() OVER (PARTITION BY a.event_id ORDER BY (a.user_id = b.user_id) DESC, abs(a.sec - b.sec), b.event_id) AS r
FROM e a JOIN e b ON a.event_type = 'error' AND b.event_type = 'purchase' AND abs(a.sec - b.sec) <= 28800)
SELECT event_id, near_id, same_user FROM m WHERE r = 1""")
def q_band_nearest(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "event_type", F.unix_timestamp("ts").alias("at"))
    a, b = e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'").select("key", "at", F.col("event_id").alias("near_id"))
    return interval.band_nearest(a, b, "event_id", "at", 28800, "key", "near_id").select("event_id", "near_id", F.col("preferred").alias("same_user"))


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, value, {_EV} FROM events), p AS (SELECT * FROM e WHERE event_type = 'purchase')
SELECT event_id, coalesce((SELECT value FROM p WHERE p.user_id = a.user_id AND p.sec <= a.sec ORDER BY p.sec DESC, p.event_id DESC LIMIT 1),
(SELECT value FROM p WHERE p.sec <= a.sec ORDER BY p.sec DESC, p.event_id DESC LIMIT 1), (SELECT value FROM p ORDER BY p.sec DESC, p.event_id DESC LIMIT 1)) AS value FROM e a WHERE event_type = 'error'""")
def q_asof_scoped(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("at"))
    defs = e.where("event_type = 'purchase'").select("user_id", F.col("at").alias("def_at"), F.col("event_id").alias("seq"), "value")
    uses = e.where("event_type = 'error'").select("event_id", "user_id", "at")
    return asof.scoped(uses, defs, ["user_id"], "at", "def_at", "value", "seq").select("event_id", "value")


@query("""SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS state,
CASE WHEN event_type = 'click' THEN event_id * 8 WHEN event_type = 'view' THEN event_id // 8 ELSE event_id END AS unit FROM events""")
def q_object_state(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("set", F.when(F.col("value") > 20, F.col("value")))
    unit = state.transform_unit(F.col("event_id"), F.when(F.col("event_type") == "click", "bytes_to_bits").when(F.col("event_type") == "view", "bits_to_bytes").otherwise("none"))
    return asof.running_state(e, ["user_id"], "event_type", ["ts", "event_id"], "set").select("event_id", "state", unit.alias("unit"))


@query("""SELECT event_id, event_type || '@v' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS object_id FROM events""")
def q_object_version(spark, sf_dir):
    return rank.versions(read(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "event_type").select("event_id", "object_id")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN json_extract(props, '$.k')::BIGINT END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS context FROM events""")
def q_receiver_context(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return asof.context_of(e, ["user_id"], ["ts", "event_id"], "event_type = 'signup'", "k").select("event_id", "context")


@query("""SELECT conv_id, turn, first_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM conversations""")
def q_turn_asof(spark, sf_dir):
    return asof.next_matching(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], "role = 'assistant'", "turn").select("conv_id", "turn", "following")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
w AS (SELECT event_id AS seed, event_id AS node, 0 AS hop FROM e UNION ALL SELECT seed, previous, hop + 1 FROM w JOIN e ON e.event_id = w.node WHERE previous IS NOT NULL AND hop < 12)
SELECT seed, max(hop)::BIGINT AS hops, min(node) AS lowest FROM w GROUP BY 1""")
def q_backward_slice(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.lag("event_id").over(w).alias("previous"))
    return graph.backward_slice(steps, steps.select("node"), 12).groupBy("seed").agg(long(F.max("hop")).alias("hops"), F.min("node").alias("lowest"))


# ---- parameters, linear forms, constraints ----


@query("""SELECT o.l_orderkey, p.name, q AS quantity FROM (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS qs FROM lineitem GROUP BY 1) o,
(VALUES (1, 'key'), (2, 'iv'), (3, 'mode')) AS p(i, name), (SELECT 1), LATERAL (SELECT qs[p.i] AS q) x WHERE q IS NOT NULL""")
def q_bind_params(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("a"))
    calls = lines.select("l_orderkey", F.lit("f").alias("callee"), F.transform("a", lambda x: x["l_quantity"]).alias("args"))
    functions = spark.createDataFrame([("f", ["key", "iv", "mode"])], "callee string, params array<string>")
    return match.bind_params(calls, functions, "callee").select("l_orderkey", "name", F.col("value").alias("quantity"))


@query("""WITH x AS (SELECT p_partkey, p_size::BIGINT * 100 AS t, (1 + p_partkey % 7)::BIGINT AS a, (p_partkey % 11)::BIGINT AS b FROM part)
SELECT p_partkey, ceil((t - b)::DOUBLE / a)::BIGINT AS geq, floor((t - b)::DOUBLE / a)::BIGINT AS leq, CASE WHEN (t - b) % a = 0 THEN (t - b) // a END AS exact FROM x""")
def q_linear_reverse(spark, sf_dir):
    t, a, b = long("p_size") * 100, long(F.col("p_partkey") % 7) + 1, long(F.col("p_partkey") % 11)
    return read(spark, sf_dir, "part").select("p_partkey", linear.at_least(t, a, b).alias("geq"), linear.at_most(t, a, b).alias("leq"), linear.reverse_exact(t, a, b).alias("exact"))


@query("""WITH c AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'GEQ' WHEN 1 THEN 'LEQ' WHEN 2 THEN 'EQ' ELSE 'GEQ' END AS pred, 256 * (1 + p_size % 16) AS t, p_size % 4 AS arg FROM part)
SELECT p_partkey, CASE arg WHEN 0 THEN CASE pred WHEN 'GEQ' THEN ceil(t / 8.0)::BIGINT END WHEN 1 THEN (t - 10)::BIGINT ELSE CASE WHEN arg = 2 THEN t::BIGINT END END AS derived,
CASE arg WHEN 3 THEN 'suspect' ELSE 'confirmed' END AS confidence FROM c""")
def q_derive_constraint(spark, sf_dir):
    i = F.col("p_size") % 4 + 1
    pred = F.element_at(F.array(*[F.lit(x) for x in ("GEQ", "LEQ", "EQ", "GEQ")]), i)
    arg = F.element_at(F.array(*[F.lit(x) for x in ("keylen*8", "size + 10", "bits", "f(bits)")]), i)
    rows = read(spark, sf_dir, "part").select("p_partkey", pred.alias("pred"), arg.alias("arg"), (long(F.col("p_size") % 16) * 256 + 256).alias("t"))
    return constraint.derive(rows, "pred", "t", "arg").select("p_partkey", "derived", "confidence")


@query("""WITH v AS (SELECT l_orderkey, l_linenumber::BIGINT AS seq, CASE WHEN l_quantity = 13 THEN NULL ELSE l_quantity >= 3 END AS ok FROM lineitem),
b AS (SELECT l_orderkey, min(seq * 10 + CASE WHEN ok IS NULL THEN 1 ELSE 0 END) AS f, count(*) AS n FROM v WHERE ok IS NULL OR NOT ok GROUP BY 1)
SELECT v.l_orderkey, CASE WHEN max(f) IS NULL THEN 'SAT' WHEN max(f) % 10 = 1 THEN 'UNKNOWN' ELSE 'UNSAT' END AS status FROM v LEFT JOIN b USING (l_orderkey) GROUP BY 1""")
def q_contract_sat(spark, sf_dir):
    q = F.when(F.col("l_quantity") != 13, F.col("l_quantity"))
    rows = read(spark, sf_dir, "lineitem").withColumn("ok", constraint.holds(F.lit("GEQ"), q, F.lit(3.0))).withColumn("seq", long("l_linenumber") * 10 + F.when(F.col("ok").isNull(), 1).otherwise(0))
    return constraint.contract_status(rows, ["l_orderkey"], F.col("ok"), "seq")


_CONS = "SELECT p_brand AS param, CASE p_size % 3 WHEN 0 THEN 'GEQ' WHEN 1 THEN 'LEQ' ELSE 'EQ' END AS predicate, p_size::BIGINT AS value FROM part"


def _constraints(spark, sf_dir):
    pred = F.element_at(F.array(F.lit("GEQ"), F.lit("LEQ"), F.lit("EQ")), F.col("p_size") % 3 + 1)
    return constraint.simplify(read(spark, sf_dir, "part").select(F.col("p_brand").alias("param"), pred.alias("predicate"), long("p_size").alias("value")), "param", "predicate", "value")


_SIMPLE = f"SELECT param, predicate, CASE WHEN predicate = 'GEQ' THEN max(value) ELSE min(value) END AS value FROM ({_CONS}) GROUP BY param, predicate, CASE WHEN predicate = 'EQ' THEN value END"


@query(_SIMPLE)
def q_simplify_constraints(spark, sf_dir):
    return _constraints(spark, sf_dir).select("param", "predicate", "value")


@query(f"""WITH s AS (SELECT param, predicate AS p, value AS v, predicate || ':' || value AS id FROM ({_SIMPLE}))
SELECT a.param, a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.param = b.param AND a.id < b.id WHERE (a.p = 'GEQ' AND b.p = 'LEQ' AND a.v > b.v) OR (a.p = 'LEQ' AND b.p = 'GEQ' AND a.v < b.v)
OR (a.p = 'EQ' AND b.p = 'EQ' AND a.v <> b.v) OR (a.p = 'EQ' AND b.p = 'GEQ' AND a.v < b.v) OR (a.p = 'EQ' AND b.p = 'LEQ' AND a.v > b.v)""")
def q_conflicts(spark, sf_dir):
    return constraint.conflicts(_constraints(spark, sf_dir).withColumn("id", F.concat("predicate", F.lit(":"), "value")), "param")


def _profiles(spark):
    schema = "profile_id string, mode string, param string, min_bits long, has_min boolean, forbidden array<long>, severity string, severity_map map<string,string>, recommended array<string>, reason string"
    return spark.createDataFrame(
        [
            ("ALG.RSA.PKE", "quantum", "key_bits", None, False, [], "critical", {}, [], "no resistant size"),
            ("ALG.RSA.PKE", "classic", "key_bits", None, True, [512, 1024], "error", {"2048": "info"}, [], "short modulus"),
            ("ALG.AES", "quantum", "key_bits", 256, True, [], None, {"128": "warning", "256": "none"}, [], "halved by search"),
            ("ALG.AES", "classic", "mode", None, True, [], None, {"ECB": "error"}, [], "pattern leak"),
            ("ALG.MD5", "quantum", "digest_bits", None, True, [], "critical", {}, [], "collisions"),
        ],
        schema,
    )


_CAND = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ALG.RSA.PKE' WHEN 1 THEN 'ALG.AES' ELSE 'ALG.MD5' END AS profile_id, CASE WHEN p_size % 7 <> 0 THEN (p_size * 64)::BIGINT END AS key_bits, CASE WHEN p_size % 2 = 0 THEN 'ecb' ELSE 'gcm' END AS bmode FROM part"


def _candidates(spark, sf_dir):
    profile = F.element_at(F.array(F.lit("ALG.RSA.PKE"), F.lit("ALG.AES"), F.lit("ALG.MD5")), F.col("p_size") % 3 + 1)
    return read(spark, sf_dir, "part").select("p_partkey", profile.alias("profile_id"), F.when(F.col("p_size") % 7 != 0, long("p_size") * 64).alias("key_bits"), F.when(F.col("p_size") % 2 == 0, "ecb").otherwise("gcm").alias("bmode"))


_VIOL = f"""WITH c AS ({_CAND})
SELECT p_partkey, profile_id, 'quantum' AS mode, CASE WHEN key_bits IS NULL THEN 'algorithm' ELSE 'key_bits' END AS parameter, key_bits::VARCHAR AS value, 'critical' AS level FROM c WHERE profile_id = 'ALG.RSA.PKE'
UNION ALL SELECT p_partkey, profile_id, 'classic', 'key_bits', key_bits::VARCHAR, CASE WHEN key_bits = 2048 THEN 'info' ELSE 'error' END FROM c WHERE profile_id = 'ALG.RSA.PKE' AND key_bits IN (512, 1024, 2048)
UNION ALL SELECT p_partkey, profile_id, 'quantum', 'key_bits', key_bits::VARCHAR, 'warning' FROM c WHERE profile_id = 'ALG.AES' AND key_bits = 128
UNION ALL SELECT p_partkey, profile_id, 'quantum', 'key_bits', key_bits::VARCHAR, 'warning' FROM c WHERE profile_id = 'ALG.AES' AND key_bits < 256
UNION ALL SELECT p_partkey, profile_id, 'classic', 'mode', 'ECB', 'error' FROM c WHERE profile_id = 'ALG.AES' AND bmode = 'ecb'
UNION ALL SELECT p_partkey, profile_id, 'quantum', 'digest_bits', NULL, 'critical' FROM c WHERE profile_id = 'ALG.MD5'"""


def _violations(spark, sf_dir):
    return constraint.check(_candidates(spark, sf_dir), _profiles(spark), {"key_bits": "key_bits"}, "bmode")


@query(_VIOL)
def q_constraint_check(spark, sf_dir):
    return _violations(spark, sf_dir).select("p_partkey", "profile_id", "mode", "parameter", "value", "level")


@query(f"""WITH v AS ({_VIOL}), m AS (SELECT *, CASE level WHEN 'critical' THEN 'high' WHEN 'error' THEN 'high' WHEN 'warning' THEN 'medium' WHEN 'info' THEN 'low' END AS severity FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, mode DESC, parameter) AS rn FROM m)
SELECT p_brand, severity, count(*) AS n FROM r JOIN part USING (p_partkey) WHERE rn = 1 GROUP BY 1, 2""")
def q_policy_report(spark, sf_dir):
    """The flagship: which records violate a numeric policy, at what severity, per group."""
    v = _violations(spark, sf_dir).withColumn("severity", levels.of_constraint(F.col("level")))
    top = rank.best(v, ["p_partkey"], [levels.rank(F.col("severity")).desc(), F.col("mode").desc(), F.col("parameter")])
    return top.join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").groupBy("p_brand", "severity").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT p_partkey, p_size, p_size * 64 AS kb, CASE p_size % 4 WHEN 0 THEN 'warning' END AS ql, CASE WHEN p_size % 4 = 1 AND p_size * 64 < 2048 THEN 'error' END AS cl,
CASE p_size % 5 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' WHEN 2 THEN 'broken' END AS qs, (p_size * 4)::BIGINT AS qb FROM part)
SELECT p_partkey, CASE WHEN ql IS NOT NULL THEN CASE WHEN kb < 1024 THEN 'high' ELSE 'medium' END WHEN cl IS NOT NULL THEN 'high' WHEN qs = 'strong' THEN 'info' WHEN qs = 'weak' THEN 'medium' WHEN qs = 'broken' THEN 'high'
WHEN qb < 64 THEN 'high' WHEN qb < 128 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN p_size % 6 = 0 THEN 'low' WHEN qs = 'weak' THEN 'medium' WHEN qs = 'strong' THEN 'info' ELSE 'high' END AS rule_severity FROM x""")
def q_severity(spark, sf_dir):
    size = F.col("p_size")
    kb = long("p_size") * 64
    secure = F.when(size % 5 == 0, "strong").when(size % 5 == 1, "weak").when(size % 5 == 2, "broken")
    classic = F.when((size % 4 == 1) & levels.in_range(kb, F.lit("< 2048")), "error")
    ladder = levels.of_profile(F.when(size % 4 == 0, "warning"), F.lit(1024), classic, secure, long("p_size") * 4, kb)
    return read(spark, sf_dir, "part").select("p_partkey", ladder.alias("severity"), levels.of_rule(size % 6 == 0, secure, F.lit(False)).alias("rule_severity"))


# ---- ranking and aggregation ----


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS line, l_partkey, round(l_discount, 2) AS discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_discount DESC, l_tax, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def q_dedup_findings(spark, sf_dir):
    order = [F.col("l_discount").desc(), *map(F.col, ("l_tax", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))]
    return rank.best(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", long("l_linenumber").alias("line"), "l_partkey", F.round("l_discount", 2).alias("discount"))


@query("""SELECT user_id, minute, event_id FROM (SELECT user_id, floor(epoch(ts))::BIGINT // 3600 AS minute, event_id, row_number() OVER (PARTITION BY user_id, floor(epoch(ts))::BIGINT // 3600 ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END, value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def q_upsert_strongest(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("minute", F.floor(F.unix_timestamp("ts") / 3600).cast("long"))
    source = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).otherwise(2)
    return rank.best(e, ["user_id", "minute"], [source, F.col("value").desc(), F.col("event_id")]).select("user_id", "minute", "event_id")


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders) WHERE rank <= 3""")
def q_top_per_key(spark, sf_dir):
    return rank.top_per_key(read(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", long("rank").alias("rank"))


@query("""SELECT event_id FROM (SELECT event_id, event_type, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id, ts::DATE) AS a FROM events) WHERE event_type = 'purchase' OR a = 0""")
def q_anchor_prune(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return rank.has_anchor(e, ["user_id", "day"], F.col("event_type") == "purchase").select("event_id")


@query("""SELECT alias, min(target) AS target FROM (SELECT p_name AS alias, p_type AS target FROM part UNION ALL SELECT s_name, s_nationkey::VARCHAR FROM supplier UNION ALL SELECT s_name, s_nationkey::VARCHAR FROM supplier) GROUP BY 1 HAVING min(target) = max(target)""")
def q_unique_alias(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select(F.col("p_name").alias("alias"), F.col("p_type").alias("target"))
    suppliers = read(spark, sf_dir, "supplier").select(F.col("s_name").alias("alias"), F.col("s_nationkey").cast("string").alias("target"))
    return rank.unique_alias(parts.unionByName(suppliers).unionByName(suppliers), "alias", "target").select("alias", "target")


@query("""SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN min(event_type) = max(event_type) THEN min(event_type) END AS event_type FROM events GROUP BY 1, 2""")
def q_phi_consensus(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts").cast("string"))
    return rank.consensus(e, ["user_id", "day"], "event_type")


@query("""WITH h AS (SELECT user_id, day(ts) <= 15 AS a, list_sort(list_distinct(list(event_type))) AS v, round(max(value), 4) AS c FROM events GROUP BY 1, 2)
SELECT coalesce(x.user_id, y.user_id) AS user_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(x.v, []), coalesce(y.v, [])))), ',') AS vals,
round(CASE WHEN x.v <> y.v THEN least(x.c, y.c) * 0.9 ELSE least(x.c, y.c) END, 3) AS confidence FROM (SELECT * FROM h WHERE a) x FULL JOIN (SELECT * FROM h WHERE NOT a) y ON x.user_id = y.user_id""")
def q_state_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    half = lambda cond: e.where(cond).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("values"), F.round(F.max("value"), 4).alias("confidence"))
    return state.merge_states(half(F.dayofmonth("ts") <= 15), half(F.dayofmonth("ts") > 15), ["user_id"]).select("user_id", F.array_join("values", ",").alias("vals"), F.round("confidence", 3).alias("confidence"))


_FIND = "SELECT source, lang, CASE WHEN toxic = 1 THEN 'high' WHEN quality = 0 THEN 'medium' ELSE 'info' END AS severity FROM labels JOIN documents USING (doc_id)"


def _labelled(spark, sf_dir):
    level = F.when(F.col("toxic") == 1, "high").when(F.col("quality") == 0, "medium").otherwise("info")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id").select("source", "lang", level.alias("severity"))


@query(f"""SELECT source, count(*) AS findings, count_if(severity = 'info')::BIGINT AS info, count_if(severity = 'low')::BIGINT AS low, count_if(severity = 'medium')::BIGINT AS medium, count_if(severity = 'high')::BIGINT AS high, count_if(severity = 'critical')::BIGINT AS critical FROM ({_FIND}) GROUP BY 1""")
def q_report_severity(spark, sf_dir):
    return report.by_severity(_labelled(spark, sf_dir), ["source"])


@query(f"""SELECT source, lang, severity, count(*) AS n FROM ({_FIND}) GROUP BY ROLLUP (source, lang, severity)""")
def q_folder_rollup(spark, sf_dir):
    return report.rollup(_labelled(spark, sf_dir), "source", "lang")


@query("""SELECT CASE p_size % 5 WHEN 0 THEN 'dynamic' WHEN 1 THEN 'utility' WHEN 2 THEN 'missing' ELSE 'unmapped' END AS reason, count(*) AS n FROM part WHERE p_size % 5 <> 3 GROUP BY 1""")
def q_unknown_reasons(spark, sf_dir):
    profile = F.element_at(F.array(F.lit("ALG.DYNAMIC"), F.lit("UTIL.KEY"), F.lit(""), F.lit("ALG.AES"), F.lit("misc")), F.col("p_size") % 5 + 1)
    return report.unknown_reasons(read(spark, sf_dir, "part").select(profile.alias("profile")), "profile")


@query("""SELECT p_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_brand))), ', ') AS places FROM part GROUP BY 1""")
def q_group_locations(spark, sf_dir):
    return report.locations(read(spark, sf_dir, "part"), "p_type", "p_brand")


# ---- names and sizes ----


@query("""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 128 WHEN 1 THEN 168 WHEN 2 THEN 256 WHEN 3 THEN 384 WHEN 4 THEN 128 END::BIGINT AS key_bits, CASE p_size % 6 WHEN 0 THEN 'CBC' WHEN 3 THEN NULL ELSE NULL END AS mode FROM part""")
def q_name_bits(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(x) for x in ("EVP_aes_128_cbc", "des-ede3", "HMAC_SHA256", "P-384", "MD5", "frobnicate")]), F.col("p_size") % 6 + 1)
    named = read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 6 == 0, bits.api_name_bits(name)).when(F.col("p_size") % 6 == 2, bits.api_name_bits(name)).otherwise(bits.algorithm_bits(name)).alias("key_bits"), algorithms.mode_of(name).alias("mode"))
    return named.select("p_partkey", long("key_bits").alias("key_bits"), "mode")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'AES' WHEN 1 THEN 'AES' WHEN 2 THEN 'DESEDE' WHEN 3 THEN 'RSA' ELSE 'RC4' END AS algorithm, CASE p_size % 5 WHEN 0 THEN 'CBC' WHEN 1 THEN 'GCM' WHEN 3 THEN 'ECB' END AS mode,
CASE p_size % 5 WHEN 0 THEN 'PKCS5Padding' WHEN 2 THEN 'PKCS5Padding' WHEN 3 THEN 'OAEPPadding' END AS padding, CASE p_size % 5 WHEN 2 THEN 'ALG.3DES' WHEN 3 THEN 'ALG.RSA' WHEN 4 THEN 'ALG.RC4' ELSE 'ALG.AES' END AS profile FROM part""")
def q_transformation(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(x) for x in ("AES/CBC/PKCS5Padding", "AES/GCM", "DESede/PKCS5Padding", '"RSA/ECB/OAEPPadding"', "RC4")]), F.col("p_size") % 5 + 1)
    return read(spark, sf_dir, "part").withColumn("t", algorithms.transformation(text)).select("p_partkey", "t.algorithm", "t.mode", "t.padding", algorithms.transformation_profile(text).alias("profile"))


# ---- graphs: customers call the first supplier of their orders, suppliers the next one of an order with a higher number, then their nation and region.
# Roots are the sources and regions the sinks; depths are the operators' own (forward 8, backward 12, contracts 10). ----

_EDGES = """WITH RECURSIVE l AS (SELECT l_orderkey, l_suppkey, row_number() OVER w AS i, lead(l_suppkey) OVER w AS nxt FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
edges AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM orders JOIN l ON l_orderkey = o_orderkey AND i = 1 UNION SELECT 's' || l_suppkey, 's' || nxt FROM l WHERE l_suppkey < nxt
UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
roots AS (SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges))"""


def _edges(spark, sf_dir):
    name = lambda kind, key: F.concat(F.lit(kind), key)
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.row_number().over(w).alias("i"), F.lead("l_suppkey").over(w).alias("nxt"))
    first = read(spark, sf_dir, "orders").join(lines.where("i = 1"), F.col("o_orderkey") == F.col("l_orderkey")).select(name("c", "o_custkey").alias("src"), name("s", "l_suppkey").alias("dst"))
    supplier, nation = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    every = first.unionByName(lines.where("l_suppkey < nxt").select(name("s", "l_suppkey").alias("src"), name("s", "nxt").alias("dst")))
    every = every.unionByName(supplier.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).unionByName(nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    return cut(every.distinct())


def _sinks(spark, sf_dir):
    return read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


@query("""SELECT doc_id, coalesce(arg_max(owner, start), '<global>') AS src, regexp_extract(callee, '[^.]+$') AS dst FROM (SELECT doc_id, 'f' || i AS owner, i * 100 AS start, n_chars FROM documents, (SELECT unnest(range(3)) AS i) WHERE n_chars > i * 100) f
RIGHT JOIN (SELECT doc_id, n_chars, lang || '.' || source AS callee FROM documents) c USING (doc_id, n_chars) GROUP BY doc_id, callee""")
def q_call_graph(spark, sf_dir):
    """A document is a file with up to three functions, 100 lines each and the last open to its end, and one call at its last line."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), "n_chars", "lang", "source")
    functions = docs.select("file_path", F.explode(F.array(*[F.struct(F.lit(f"f{i}").alias("name"), F.lit(i * 100 + 1).cast("long").alias("line"), F.greatest(F.col("n_chars"), F.lit(i * 100 + 1)).cast("long").alias("end_line"), F.lit(i).alias("seq"), (F.col("n_chars") > i * 100).alias("is")) for i in range(3)])).alias("f")).select("file_path", "f.*").where("is")
    calls = docs.select("file_path", F.col("file_path").alias("call_id"), F.col("n_chars").cast("long").alias("line"), F.concat_ws(".", "lang", "source").alias("symbol"))
    return wrappers.call_graph(functions, calls).select(F.col("file_path").alias("doc_id"), "src", "dst")


@query(f"{_EDGES} SELECT node FROM roots")
def q_roots(spark, sf_dir):
    return graph.roots(_edges(spark, sf_dir))


_FWD = "r(node, depth) AS (SELECT node, 0 FROM roots UNION SELECT dst, depth + 1 FROM r JOIN edges ON src = node WHERE depth < 8)"
_BACK = "b(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region UNION SELECT src, depth + 1 FROM b JOIN edges ON dst = node WHERE depth < 12)"


@query(f"{_EDGES}, {_FWD} SELECT node, min(depth)::BIGINT AS depth FROM r GROUP BY 1 HAVING min(depth) > 0")
def q_reach_fwd(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.closure(edges, graph.roots(edges), 8)


@query(f"{_EDGES}, {_BACK} SELECT node, min(depth)::BIGINT AS depth FROM b GROUP BY 1")
def q_reach_back(spark, sf_dir):
    return graph.closure(graph.reverse(_edges(spark, sf_dir)), _sinks(spark, sf_dir), 12, include_seeds=True)


@query(f"{_EDGES}, {_FWD}, {_BACK} SELECT node FROM r INTERSECT SELECT node FROM b")
def q_prune_fb(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return graph.between(edges, graph.roots(edges), _sinks(spark, sf_dir), 8, 12).select("node")


@query(f"{_EDGES}, {_BACK} SELECT node, min(depth)::BIGINT AS depth FROM b WHERE node IN (SELECT node FROM roots) GROUP BY 1")
def q_entry_points(spark, sf_dir):
    return graph.entry_points(_edges(spark, sf_dir), _sinks(spark, sf_dir), 12)


def _tree(spark, sf_dir):
    """region -> nation -> customer, as names."""
    r, n, c = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    up = n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return up.unionByName(c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))


@query("""SELECT 'c' || c_custkey AS target, 'r' || n_regionkey || '>n' || n_nationkey || '>c' || c_custkey AS path, 2::BIGINT AS length FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000""")
def q_k_paths(spark, sf_dir):
    sources = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    targets = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.shortest_paths(_tree(spark, sf_dir), sources, targets, 2, 8).select("target", "path", long("length").alias("length"))


@query("""SELECT 'c' || c_custkey AS name, 'ALG.' || n_regionkey AS profile, 2::BIGINT AS level FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'ALG.' || n_regionkey, 1 FROM nation UNION ALL SELECT 'r' || r_regionkey, 'ALG.' || r_regionkey, 0 FROM region""")
def q_wrapper_fixpoint(spark, sf_dir):
    calls = _tree(spark, sf_dir).select(F.col("dst").alias("caller"), F.col("src").alias("callee"))
    known = read(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("name"), F.concat(F.lit("ALG."), "r_regionkey").alias("profile"), F.lit(1).alias("priority"))
    return graph.wrapper_fixpoint(calls, known).select("name", "profile", "level")


@query("""SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey::BIGINT * 128 END, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey::BIGINT * 1024 END) AS inherited FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_chain_inherit(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    c = read(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select("c_custkey", F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")).alias("chain"))
    values = n.where("n_nationkey % 3 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("name"), (long("n_nationkey") * 128).alias("value"))
    values = values.unionByName(read(spark, sf_dir, "region").where("r_regionkey % 2 = 0").select(F.concat(F.lit("r"), "r_regionkey").alias("name"), (long("r_regionkey") * 1024).alias("value")))
    return graph.inherit_along_chain(rows, "c_custkey", "chain", values, "name", "value").select("c_custkey", "inherited")


@query("""WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS a, 'c' || c_custkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w(node, label) AS (SELECT a, a FROM s UNION SELECT s.b, label FROM w JOIN s ON s.a = w.node) SELECT node, min(label) AS component FROM w GROUP BY 1""")
def q_alias_components(spark, sf_dir):
    return graph.components(read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst")))


# a call site's verdict depends on its caller alone, so that a node has one status by whatever way it is reached
_LAST = "ascii(right(src, 1))"


@query(f"""{_EDGES}, ev AS (SELECT src, dst, CASE WHEN {_LAST} % 5 = 0 THEN NULL ELSE {_LAST} % 3 = 0 END AS ok FROM edges),
w(node, depth, status) AS (SELECT 'r' || r_regionkey, 0, 'SENSITIVE' FROM region UNION
SELECT src, depth + 1, CASE WHEN ok THEN 'PRUNED' WHEN NOT ok THEN 'PROPAGATED' ELSE 'SUSPECT' END FROM w JOIN ev ON dst = node WHERE status <> 'PRUNED' AND depth < 10),
f AS (SELECT node, depth, status, row_number() OVER (PARTITION BY node ORDER BY depth, CASE status WHEN 'PROPAGATED' THEN 0 WHEN 'SUSPECT' THEN 1 ELSE 2 END) AS r FROM w)
SELECT node, depth::BIGINT AS depth, CASE WHEN status IN ('PROPAGATED', 'SUSPECT') AND node NOT IN (SELECT dst FROM edges) THEN 'ENTRY' ELSE status END AS status FROM f WHERE r = 1""")
def q_propagate_contract(spark, sf_dir):
    last = F.ascii(F.right("src", F.lit(1)))
    return graph.propagate_contract(_edges(spark, sf_dir), _sinks(spark, sf_dir), F.when(last % 5 != 0, last % 3 == 0), 10)
