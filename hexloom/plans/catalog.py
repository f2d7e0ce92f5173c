"""The query catalogue: every documented query and relational operator over the driver's tables, each with its SQL.

The tables stand in for the engine's own: region = environment, nation = account, customer = component, orders =
module call, lineitem = resource, part = resource type, supplier = provider, events.props = attributes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import columns as C
from hexloom.operators import cascade, dedup, edges, expand, providers, summary
from hexloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class _Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self._at = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(*self._at, name)


def over(sql: str | None):
    """Registers f(tables) as a query."""

    def register(f):
        def run(spark, sf_dir):
            return f(_Tables(spark, sf_dir))

        run.__name__ = f.__name__
        return query(sql)(run)

    return register


def long(c):
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# documented queries


@over("SELECT o_custkey AS component, count(l_orderkey) AS edges FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY 1 ORDER BY edges DESC")
def q1_edges_per_component(t):
    o = t.orders.filter("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("component"))
    # edges are counted per resource before they are joined: the join carries one row for each
    per = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return o.join(per, o["o_orderkey"] == per["l_orderkey"], "left").groupBy("component").agg(F.sum(F.coalesce("n", F.lit(0))).alias("edges")).orderBy(F.desc("edges"))


@over("SELECT o_custkey AS component, count(*) AS resources FROM orders GROUP BY 1 ORDER BY resources DESC, component LIMIT 10")
def q2_top_components(t):
    return t.orders.groupBy(F.col("o_custkey").alias("component")).agg(F.count(F.lit(1)).alias("resources")).orderBy(F.desc("resources"), "component").limit(10)


@over("SELECT a.l_orderkey, a.l_partkey AS from_part, b.l_partkey AS to_part, count(*) AS n FROM lineitem a JOIN orders ON o_orderkey = a.l_orderkey JOIN lineitem b ON b.l_orderkey = a.l_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2, 3")
def q3_two_sided_self_join(t):
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
    a = l.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("from_part"))
    b = l.filter("l_returnflag = 'A'").select("l_orderkey", F.col("l_partkey").alias("to_part"))
    o = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return o.join(a, "l_orderkey").join(b, "l_orderkey").groupBy("l_orderkey", "from_part", "to_part").agg(F.count(F.lit(1)).alias("n"))


@over("SELECT n_name AS account, c_mktsegment AS type, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1 GROUP BY 1, 2 ORDER BY n DESC, account, type LIMIT 10")
def q4_account_type_counts(t):
    n = t.nation.filter("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("account"))
    c = t.customer.join(n, F.col("c_nationkey") == n["n_nationkey"])
    return c.groupBy("account", F.col("c_mktsegment").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "account", "type").limit(10)


@over("SELECT json_extract_string(props, '$.k') AS team, count(*) AS n, count(DISTINCT user_id) AS accounts FROM events GROUP BY 1 HAVING count(*) > 2")
def q5_json_group_having(t):
    e = t.events.select(C.json_field("props", "$.k").alias("team"), "user_id")
    return e.groupBy("team").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("accounts")).filter("n > 2")


@over("SELECT o_orderkey, trim(o_orderpriority) AS count_expr FROM orders WHERE trim(o_orderpriority) <> '' AND o_orderstatus = 'P'")
def q6_templates_only(t):
    return t.orders.filter("o_orderstatus = 'P'").select("o_orderkey", C.trim("o_orderpriority", " ").alias("count_expr")).filter("count_expr <> ''")


@over("SELECT c_mktsegment AS kind, l_returnflag AS edge_kind, count(*) AS n, count(DISTINCT c_custkey) AS components FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def q7_three_table_join(t):
    per = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).alias("k"))
    j = per.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey").join(t.customer.select("c_custkey", "c_mktsegment"), "c_custkey")
    return j.groupBy(F.col("c_mktsegment").alias("kind"), F.col("l_returnflag").alias("edge_kind")).agg(F.sum("k").alias("n"), F.countDistinct("c_custkey").alias("components"))


@over("SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < DATE '1996-01-01' AND l_returnflag = 'N')")
def q8_dependents_of(t):
    l = t.lineitem.filter((F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "N")).select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(l, "o_orderkey", "left_semi")


# classification and addresses


@over("""SELECT page_id, CASE WHEN regexp_extract(url, '([^/]*)$', 1) = 'terragrunt.hcl' THEN 'terragrunt.hcl' WHEN regexp_matches(url, '[.](tf|tfvars|hcl|json)$') THEN regexp_extract(url, '[.](tf|tfvars|hcl|json)$', 1) ELSE 'other' END AS kind FROM pages""")
def scan_ext_classify(t):
    return t.pages.select("page_id", F.coalesce(C.file_kind("url"), F.lit("other")).alias("kind"))


@over("""SELECT source, bool_or(regexp_matches(text, '(^|\\n)[A-Z][a-z]+ [a-z]+ ')) AS has_resource, bool_or(regexp_matches(text, '###')) AS has_backend, bool_or(regexp_matches(text, '[0-9]{3}')) AS has_data, bool_or(text LIKE '%token =%') AS has_variable FROM documents GROUP BY 1""".replace("\\\\n", "\\n"))
def probe_regex_flags(t):
    flags = {"has_resource": r"(^|\n)[A-Z][a-z]+ [a-z]+ ", "has_backend": "###", "has_data": "[0-9]{3}", "has_variable": "token ="}
    d = t.documents.select("source", *(F.col("text").rlike(p).alias(k) for k, p in flags.items()))
    return d.groupBy("source").agg(*(F.bool_or(k).alias(k) for k in flags))


_KIND_SQL = "CASE WHEN starts_with({0}, './') OR starts_with({0}, '../') THEN 'local' WHEN starts_with({0}, 'git::') OR starts_with({0}, 'git@') OR contains({0}, '.git') OR contains({0}, 'github.com/') THEN 'git' WHEN length({0}) - length(replace({0}, '/', '')) >= 2 AND NOT starts_with({0}, '/') THEN 'registry' ELSE 'external' END"


@over(f"SELECT page_id, {_KIND_SQL.format('url')} AS kind, {_KIND_SQL.format('s')} AS rewritten FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN '../' || url WHEN 1 THEN 'git::' || url WHEN 2 THEN replace(url, 'https://', '') ELSE split_part(url, '/', 3) END AS s FROM pages)")
def module_source_classify(t):
    k = F.col("page_id") % 4
    s = F.when(k == 0, F.concat(F.lit("../"), "url")).when(k == 1, F.concat(F.lit("git::"), "url")).when(k == 2, F.replace("url", F.lit("https://"), F.lit(""))).otherwise(F.split_part("url", F.lit("/"), F.lit(3)))
    return t.pages.select("page_id", C.module_source_kind("url").alias("kind"), C.module_source_kind(s).alias("rewritten"))


@over("SELECT p_partkey, 'module.m' || (p_partkey % 7) || '.module.' || lower(p_brand) || '.aws_part.p' || p_partkey AS address, 'm' || (p_partkey % 7) || '.' || lower(p_brand) AS module_path, 'aws_part.p' || p_partkey AS resource_part FROM (SELECT p_partkey, replace(p_brand, '#', '_') AS p_brand FROM part)")
def address_build_and_split(t):
    a = F.concat_ws(".", F.lit("module"), F.concat(F.lit("m"), F.col("p_partkey") % 7), F.lit("module"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("aws_part"), F.concat(F.lit("p"), F.col("p_partkey")))
    p = t.part.select("p_partkey", a.alias("address"))
    return p.select("p_partkey", "address", C.module_path("address").alias("module_path"), C.resource_part("address").alias("resource_part"))


@over("""SELECT c_custkey, regexp_full_match(a, '[A-Za-z0-9_./\\-\\[\\]"]+') AND length(a) - length(replace(a, '[', '')) = length(a) - length(replace(a, ']', '')) AS address_ok, regexp_full_match(acc, '[0-9]{12}') AS account_ok FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 't.' || c_name || '[0]' WHEN 1 THEN 't.' || c_name || '[' ELSE 't ' || c_name END AS a, lpad(c_custkey::VARCHAR, 9 + (c_custkey % 5)::INT, '0') AS acc FROM customer)""".replace("\\\\", "\\"))
def address_validate(t):
    k = F.col("c_custkey") % 3
    a = F.when(k == 0, F.concat(F.lit("t."), "c_name", F.lit("[0]"))).when(k == 1, F.concat(F.lit("t."), "c_name", F.lit("["))).otherwise(F.concat(F.lit("t "), "c_name"))
    acc = F.lpad(F.col("c_custkey").cast("string"), (9 + F.col("c_custkey") % 5).cast("int"), F.lit("0"))
    return t.customer.select("c_custkey", C.valid_address(a).alias("address_ok"), C.valid_account(acc).alias("account_ok"))


# functions


@over("SELECT p_partkey, p_brand || ' has ' || trunc(p_retailprice)::BIGINT || ' at 100%' AS s FROM part")
def fn_format(t):
    return t.part.select("p_partkey", C.format_text("%s has %d at 100%%", "p_brand", "p_retailprice").alias("s"))


@over("SELECT p_partkey, lower(p_name) AS low, upper(p_type) AS up FROM part")
def fn_lower_upper(t):
    return t.part.select("p_partkey", C.lower("p_name").alias("low"), C.upper("p_type").alias("up"))


@over("SELECT p_partkey, trim(p_name, 'aeiou ') AS s FROM part")
def fn_trim(t):
    return t.part.select("p_partkey", C.trim("p_name", "aeiou ").alias("s"))


@over("SELECT doc_id, length(trim(text || chr(10) || chr(9), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS n FROM documents".replace("\\\\", "\\"))
def fn_trimspace(t):
    return t.documents.select("doc_id", C.text_length(C.trim_space(F.concat("text", F.lit("\n\t")))).alias("n"))


@over("SELECT p_partkey, replace(p_type, ' ', '_') AS s FROM part")
def fn_replace(t):
    return t.part.select("p_partkey", C.replace_all("p_type", " ", "_").alias("s"))


@over("SELECT doc_id, length(text) AS chars, len(string_split(text, chr(10))) AS lines, strlen(text)::BIGINT AS bytes FROM documents")
def fn_length(t):
    return t.documents.select("doc_id", C.text_length("text").alias("chars"), C.list_length(F.split("text", "\n")).alias("lines"), long(F.octet_length("text")).alias("bytes"))


@over("SELECT doc_id, contains(text, 'the') AS has FROM documents")
def fn_strcontains(t):
    return t.documents.select("doc_id", C.str_contains("text", F.lit("the")).alias("has"))


def _map(t):
    return t.orders.select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("m"), F.create_map(F.lit("priority"), F.lit("none"), F.lit("zone"), F.col("o_custkey").cast("string")).alias("n"))


@over("SELECT o_orderkey, 'priority,status' AS ks, o_orderpriority || ',' || o_orderstatus AS vs FROM orders")
def fn_keys_values(t):
    return _map(t).select("o_orderkey", F.array_join(C.keys("m"), ",").alias("ks"), F.array_join(C.values("m"), ",").alias("vs"))


@over("SELECT o_orderkey, 'none' AS priority, o_orderstatus AS status, o_custkey::VARCHAR AS zone, 'status,priority,zone' AS names FROM orders")
def fn_merge(t):
    m = _map(t).select("o_orderkey", C.merge("m", "n").alias("x"))
    return m.select("o_orderkey", F.try_element_at("x", F.lit("priority")).alias("priority"), F.try_element_at("x", F.lit("status")).alias("status"), F.try_element_at("x", F.lit("zone")).alias("zone"), F.array_join(F.map_keys("x"), ",").alias("names"))


@over("SELECT p_partkey, array_to_string(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')), '|') AS s FROM part")
def fn_concat(t):
    return t.part.select("p_partkey", F.array_join(C.concat_lists(F.split("p_type", " "), F.split("p_name", " ")), "|").alias("s"))


@over("SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_type, 'A', '  '), ' '), lambda x: x <> ''), '|') AS s FROM part")
def fn_compact(t):
    return t.part.select("p_partkey", F.array_join(C.compact(F.split(F.replace("p_type", F.lit("A"), F.lit("  ")), " ")), "|").alias("s"))


@over("SELECT o_orderkey, o_orderstatus AS found, 'dflt' AS missing FROM orders")
def fn_lookup(t):
    return _map(t).select("o_orderkey", C.lookup("m", F.lit("status")).alias("found"), C.lookup("m", F.lit("absent"), F.lit("dflt")).alias("missing"))


@over("SELECT p_partkey, list_contains(string_split(p_type, ' '), 'STEEL') AS has FROM part")
def fn_contains(t):
    return t.part.select("p_partkey", C.contains(F.split("p_type", " "), F.lit("STEEL")).alias("has"))


@over("SELECT p_partkey, array_to_string(flatten([string_split(p_type, ' '), [p_brand]]), '|') AS s FROM part")
def fn_flatten(t):
    return t.part.select("p_partkey", F.array_join(C.flatten(F.array(F.split("p_type", " "), F.array("p_brand"))), "|").alias("s"))


@over("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def fn_toset(t):
    return t.orders.groupBy("o_custkey").agg(C.list_length(C.to_set(F.collect_list("o_orderstatus"))).alias("n"))


@over("SELECT o_orderkey, o_orderkey::VARCHAR AS s, CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END AS b, '[' || o_orderkey || ', ' || o_custkey || ']' AS l FROM orders")
def fn_tostring(t):
    return t.orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("s"), C.bool_text(F.col("o_custkey") % 2 == 0).alias("b"), C.list_text(F.array("o_orderkey", "o_custkey")).alias("l"))


@over("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bad FROM events")
def fn_tonumber(t):
    return t.events.select("event_id", C.to_integer(C.json_field("props", "$.k")).alias("n"), C.to_integer(F.concat(F.lit(" "), C.json_field("props", "$.k"))).alias("bad"))


@over("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN true WHEN 'F' THEN false END AS b FROM orders")
def fn_tobool(t):
    return t.orders.select("o_orderkey", C.to_bool(F.when(F.col("o_orderstatus") == "O", "true").when(F.col("o_orderstatus") == "F", "false").otherwise("yes")).alias("b"))


@over("""SELECT n_nationkey, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}' AS j FROM nation""")
def fn_jsonencode(t):
    return t.nation.select("n_nationkey", C.json_encode(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("j"))


@over("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def fn_jsondecode(t):
    return t.events.select("event_id", C.json_field("props", "$.k").alias("k"), C.json_field("props", "$.none").alias("none"))


@over("SELECT doc_id, base64(encode(text)) AS b, text AS back FROM documents")
def fn_base64(t):
    return t.documents.select("doc_id", C.base64_encode("text").alias("b"), C.base64_decode(C.base64_encode("text")).alias("back"))


@over("SELECT doc_id, sha256(text) AS h FROM documents")
def fn_sha256(t):
    return t.documents.select("doc_id", C.sha256("text").alias("h"))


@query(None)
def fn_sha512(spark, sf_dir):
    """No counterpart in the oracle's SQL; tested against hashlib."""
    return table(spark, sf_dir, "documents").select("doc_id", C.sha512("text").alias("h"))


@over("SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d at %H:%M:%S') AS d FROM orders")
def fn_formatdate(t):
    return t.orders.select("o_orderkey", C.format_date("YYYY/MM/DD at hh:mm:ss", "o_orderdate").alias("d"))


# expressions


@over("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_custkey - o_orderkey AS s, o_orderkey * o_custkey AS m, (o_custkey - o_orderkey) // 7 AS d, ((o_custkey - o_orderkey) % 7 + 7) % 7 AS r, NULL::BIGINT AS by_zero FROM orders")
def expr_arith(t):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select("o_orderkey", C.add(a, b).alias("a"), C.subtract(b, a).alias("s"), C.multiply(a, b).alias("m"), C.divide(b - a, F.lit(7)).alias("d"), long(C.modulo(b - a, F.lit(-7))).alias("r"), C.divide(a, F.lit(0)).alias("by_zero"))


@over("SELECT p_partkey, p_size < 25 AS lt, p_brand >= 'Brand#3' AS ge, p_size = 10 AS eq, p_name <> p_type AS ne FROM part")
def expr_compare(t):
    return t.part.select("p_partkey", (F.col("p_size") < 25).alias("lt"), (F.col("p_brand") >= "Brand#3").alias("ge"), (F.col("p_size") == 10).alias("eq"), (F.col("p_name") != F.col("p_type")).alias("ne"))


@over("SELECT p_partkey, p_size < 25 AND p_partkey % 2 = 0 AS a, p_size < 25 OR p_partkey % 2 = 0 AS o, NOT (p_size < 25) AS n, -p_size::BIGINT AS neg FROM part")
def expr_logic(t):
    x, y = F.col("p_size") < 25, F.col("p_partkey") % 2 == 0
    return t.part.select("p_partkey", (x & y).alias("a"), (x | y).alias("o"), (~x).alias("n"), C.negate(long("p_size")).alias("neg"))


@over("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'debt' END AS v FROM customer")
def expr_conditional(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).otherwise("debt").alias("v"))


@over("SELECT c_custkey, c_name || '-' || c_mktsegment || '-' || coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END, '') AS s FROM customer")
def expr_template(t):
    return t.customer.select("c_custkey", C.template("c_name", F.lit("-"), "c_mktsegment", F.lit("-"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))).alias("s"))


@over("SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_type, ' '), lambda x: length(x) > 4), lambda x: lower(x)), ',') AS s FROM part")
def for_list(t):
    return t.part.select("p_partkey", F.array_join(F.transform(F.filter(F.split("p_type", " "), lambda x: F.length(x) > 4), lambda x: F.lower(x)), ",").alias("s"))


@over("SELECT o_orderkey, 'PRIORITY=' || o_orderpriority || ',STATUS=' || o_orderstatus AS s FROM orders WHERE o_orderstatus <> 'P'")
def for_map(t):
    m = _map(t).select("o_orderkey", F.map_from_entries(F.transform(F.map_entries("m"), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value")))).alias("x"))
    return m.filter(F.try_element_at("x", F.lit("STATUS")) != "P").select("o_orderkey", F.array_join(F.transform(C.keys("x"), lambda k: F.concat(k, F.lit("="), F.element_at("x", k))), ",").alias("s"))


# recursion and graphs


@over("WITH RECURSIVE r AS (SELECT p_partkey AS start, p_partkey AS k, 0 AS depth FROM part UNION ALL SELECT start, k // 2, depth + 1 FROM r WHERE k > 1 AND depth < 20) SELECT start, min(k) AS root, max(depth)::BIGINT AS passes FROM r GROUP BY 1")
def locals_fixpoint(t):
    """Each local refers to the half of its key; substitution goes on until nothing changes, by doubling steps."""
    # pointers double each round: log2(depth) rounds
    p = t.part.select(F.col("p_partkey").alias("start"), F.when(F.col("p_partkey") > 1, F.expr("p_partkey div 2")).otherwise(F.col("p_partkey")).alias("k"), F.when(F.col("p_partkey") > 1, 1).otherwise(0).cast("bigint").alias("depth"))
    for _ in range(5):
        q = p.select(F.col("start").alias("_s"), F.col("k").alias("_k"), F.col("depth").alias("_d"))
        p = p.join(q, p["k"] == q["_s"], "left").select("start", F.coalesce("_k", "k").alias("k"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"))
    return p.select("start", F.col("k").alias("root"), F.col("depth").alias("passes"))


@over("SELECT n_nationkey, (SELECT count(*) FROM generate_series(1, 24) g(i) WHERE (n_nationkey * (1 << least(i, 24)::INT)) % 25 = n_nationkey) > 0 AS in_cycle FROM (SELECT n_nationkey::BIGINT AS n_nationkey FROM nation)")
def cycle_detect(t):
    """Local i refers to local 2i mod 25; a local is in a cycle if it reaches itself."""
    n = t.nation.select(long("n_nationkey").alias("u"))
    e = n.select("u", (F.col("u") * 2 % 25).alias("v"))
    # reachability by squaring: 5 rounds cover 32 steps
    reach = e
    for _ in range(5):
        more = reach.join(reach.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").select("u", F.col("w").alias("v"))
        reach = reach.unionByName(more).distinct()
    return n.join(reach.filter("u = v").select("u", F.lit(True).alias("c")), "u", "left").select(F.col("u").alias("n_nationkey"), F.coalesce("c", F.lit(False)).alias("in_cycle"))


@over("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN n > 1024 THEN 'r' || l_partkey ELSE 'r' || l_partkey || '[' || i || ']' END AS address, n > 1024 AS is_template FROM (SELECT *, l_linenumber AS n, unnest(CASE WHEN l_linenumber > 1024 THEN [0] ELSE range(l_linenumber) END) AS i FROM lineitem)")
def count_expand(t):
    l = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.concat(F.lit("r"), F.col("l_partkey")).alias("address"))
    return expand.expand_count(l, "l_linenumber", "address")


@over("""SELECT p_partkey, 't' || p_partkey || '["' || k || '"]' AS address, k AS each_key FROM (SELECT p_partkey, unnest(list_sort(list_distinct(string_split(p_type, ' ')))) AS k FROM part)""")
def for_each_expand(t):
    p = t.part.select("p_partkey", F.concat(F.lit("t"), F.col("p_partkey")).alias("address"), F.split("p_type", " ").alias("ks"))
    return expand.expand_keys(p, "ks", "address").select("p_partkey", "address", "each_key")


@over("""WITH RECURSIVE calls AS (SELECT n_nationkey::BIGINT AS owner, 'c' || n_nationkey AS name, (n_nationkey * 3 + 1)::BIGINT % 25 AS target FROM nation),
r AS (SELECT owner AS component, 'module.' || name || '.' AS prefix, target, [target] AS chain, 1 AS depth FROM calls UNION ALL SELECT component, prefix || 'module.' || name || '.', c.target, list_append(chain, c.target), depth + 1 FROM r JOIN calls c ON r.target = c.owner WHERE depth < 8 AND NOT list_contains(chain, c.target))
SELECT component, prefix || 's' || s_suppkey AS address, depth FROM r JOIN supplier ON s_nationkey = target""")
def module_flatten(t):
    n = F.col("n_nationkey")
    calls = t.nation.select(long(n).alias("owner"), F.concat(F.lit("c"), n).alias("name"), (long(n) * 3 + 1).alias("x")).select("owner", "name", (F.col("x") % 25).alias("target"))
    bodies = t.supplier.select(long("s_nationkey").alias("module"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("address"))
    return expand.flatten_modules(calls, bodies)


@over("SELECT coalesce(c.k, p.k)::BIGINT AS scope, coalesce(c.name, p.name) AS name, coalesce(c.target, p.target) AS target FROM (SELECT c_nationkey AS k, c_mktsegment AS name, max(c_name) AS target FROM customer WHERE c_custkey % 2 <> 0 GROUP BY 1, 2) c FULL JOIN (SELECT c_nationkey AS k, c_mktsegment AS name, min(c_name) AS target FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1, 2) p ON c.k = p.k AND c.name = p.name")
def provider_map_inherit(t):
    def side(odd, f):
        return t.customer.filter((F.col("c_custkey") % 2 != 0) == odd).groupBy(long("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("name")).agg(f("c_name").alias("target"))

    return cascade.inherit(side(False, F.min), side(True, F.max))


_CHAIN = "SELECT o_custkey AS scope, {path} AS path, o_orderkey AS level, o_orderstatus || o_orderkey AS value FROM orders"


@over(f"SELECT scope, path, value FROM ({_CHAIN.format(path='o_orderpriority')}) QUALIFY row_number() OVER (PARTITION BY scope, path ORDER BY level DESC) = 1")
def include_chain_merge_shallow(t):
    return cascade.merge_chain(t.orders.select(F.col("o_custkey").alias("scope"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("level"), F.concat("o_orderstatus", F.col("o_orderkey")).alias("value")))


@over(f"SELECT scope, path, value FROM ({_CHAIN.format(path="o_orderpriority || '/' || o_orderstatus")}) QUALIFY row_number() OVER (PARTITION BY scope, path ORDER BY level DESC) = 1")
def include_chain_merge_deep(t):
    return cascade.merge_chain(t.orders.select(F.col("o_custkey").alias("scope"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("path"), F.col("o_orderkey").alias("level"), F.concat("o_orderstatus", F.col("o_orderkey")).alias("value")))


@over("SELECT c_custkey AS scope, 'segment' AS name, CASE WHEN c_custkey % 5 = 0 THEN 'cli' WHEN c_custkey % 3 = 0 THEN 'input' ELSE c_mktsegment END AS value FROM customer")
def layered_vars(t):
    base = t.customer.select(F.col("c_custkey").alias("scope"), F.lit("segment").alias("name"), F.col("c_mktsegment").alias("value"))
    layer = lambda m, v: base.filter(F.col("scope") % m == 0).withColumn("value", F.lit(v))
    return cascade.layered(base.select("scope", "name"), [base, layer(3, "input"), layer(5, "cli")])


@over("SELECT c_custkey, c_nationkey::BIGINT AS local_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS alias, p.profile, p.region, n_name AS account FROM customer c LEFT JOIN (SELECT s_nationkey AS l, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' END AS a, arg_min('n' || (s_suppkey % 30), s_suppkey) AS profile, arg_min(s_name, s_suppkey) AS region FROM supplier GROUP BY 1, 2) p ON c_nationkey = l AND (CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) IS NOT DISTINCT FROM a LEFT JOIN nation ON p.profile = 'n' || n_nationkey")
def provider_resolve(t):
    r = t.customer.select("c_custkey", long("c_nationkey").alias("local_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("alias"))
    p = t.supplier.select(long("s_nationkey").alias("local_name"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").alias("alias"), F.col("s_suppkey").alias("ord"), F.concat(F.lit("n"), F.col("s_suppkey") % 30).alias("profile"), F.col("s_name").alias("region"))
    profiles = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("profile"), F.col("n_name").alias("account"))
    return providers.resolve(r, p, profiles).select("c_custkey", "local_name", "alias", "profile", "region", "account")


@over("SELECT c_nationkey::BIGINT AS account_id, arg_min(c_mktsegment, c_name) AS account_name FROM customer GROUP BY 1")
def account_reverse_lookup(t):
    return providers.account_names(t.customer.select(long("c_nationkey").alias("account_id"), F.col("c_mktsegment").alias("account_name"), F.col("c_name").alias("profile")))


_WANTED = "(SELECT DISTINCT l_suppkey % 40 AS profile FROM lineitem)"


@over(f"SELECT profile FROM {_WANTED} WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = profile)")
def missing_profiles(t):
    return providers.missing_profiles(t.lineitem.select((F.col("l_suppkey") % 40).alias("profile")), t.nation.select(long("n_nationkey").alias("profile")))


@over(f"SELECT count(*) AS misses FROM {_WANTED} WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = profile)")
def strict_gate_count(t):
    m = providers.missing_profiles(t.lineitem.select((F.col("l_suppkey") % 40).alias("profile")), t.nation.select(long("n_nationkey").alias("profile")))
    return m.agg(F.count(F.lit(1)).alias("misses"))


_HREF = 'href="([^"]+)"'


@over(f"SELECT page_id, (generate_subscripts(x, 1) - 1)::BIGINT AS ord, unnest(x) AS target FROM (SELECT page_id, regexp_extract_all(html, '{_HREF}', 1) AS x FROM pages)")
def extract_edges(t):
    return edges.references(t.pages, "page_id", "html", _HREF).withColumn("ord", long("ord"))


@over("SELECT l_orderkey AS from_address, l_partkey AS to_address, l_returnflag AS edge_kind, l_linenumber::BIGINT AS line, l_suppkey AS source_attr FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_returnflag ORDER BY l_linenumber, l_suppkey) = 1")
def edge_dedup_first(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("from_address"), F.col("l_partkey").alias("to_address"), F.col("l_returnflag").alias("edge_kind"), long("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_attr"))
    return edges.distinct_edges(e, ["line", "source_attr"])


@over("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1")
def address_dedup_first(t):
    l = t.lineitem.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return dedup.first_by(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@over("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) > 1")
def address_collisions(t):
    l = t.lineitem.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_partkey", "l_suppkey")
    return dedup.later_ones(l, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


def _kind(c):
    k = F.array(*map(F.lit, summary.KINDS))
    return F.element_at(k, (c % 7 + 1).cast("int"))


_KIND_OF = "(['" + "', '".join(summary.KINDS) + "'])[(o_orderkey % 7 + 1)::INT]"


@over(f"WITH r AS (SELECT o_custkey, {_KIND_OF} AS kind, o_orderpriority FROM orders) SELECT c_custkey AS component_path, " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}_count" for k in summary.KINDS) + ", coalesce(string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority), '') AS environments_seen FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY 1")
def component_summary(t):
    rows = t.orders.select(F.col("o_custkey").alias("component_path"), _kind(F.col("o_orderkey")).alias("kind"))
    seen = t.orders.select(F.col("o_custkey").alias("component_path"), F.col("o_orderpriority").alias("environment"))
    return summary.component_summary(t.customer.select(F.col("c_custkey").alias("component_path")), rows, seen).withColumn("environments_seen", F.array_join("environments_seen", ","))


@over("SELECT user_id, sum(length(s) - length(replace(s, '\"__unresolved__\":', ''))) // 17 AS unresolved_count FROM (SELECT user_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":{\"__kind__\":\"Var\",\"__unresolved__\":\"var.x\"}}' ELSE props END AS s FROM events) GROUP BY 1")
def unresolved_count(t):
    j = F.when(F.col("event_id") % 3 == 0, '{"a":{"__kind__":"Var","__unresolved__":"var.x"}}').otherwise(F.col("props"))
    return summary.unresolved_count(t.events.select("user_id", j.alias("j")), "user_id", "j")


@over("""WITH c AS (SELECT o_orderstatus AS source_kind, o_orderpriority AS source_raw, count(*) AS call_count FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1, 2),
w AS (SELECT DISTINCT o_orderstatus AS source_kind, left(o_orderpriority, 1) || CASE WHEN o_custkey % 9 = 0 THEN '' ELSE substr(o_orderpriority, 2) END AS source_raw FROM orders WHERE o_orderkey % 2 = 0)
SELECT source_kind, source_raw, call_count, EXISTS (SELECT 1 FROM w WHERE w.source_kind = c.source_kind AND w.source_raw = c.source_raw) AS resolved FROM c
UNION ALL SELECT source_kind, source_raw, 0, true FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE w.source_kind = c.source_kind AND w.source_raw = c.source_raw)""")
def modules_table(t):
    o = t.orders.withColumnRenamed("o_orderstatus", "source_kind")
    calls = o.filter("o_orderkey % 2 = 1").select("source_kind", F.col("o_orderpriority").alias("source_raw"))
    raw = F.concat(F.left("o_orderpriority", F.lit(1)), F.when(F.col("o_custkey") % 9 == 0, "").otherwise(F.expr("substr(o_orderpriority, 2)")))
    return summary.modules_table(calls, o.filter("o_orderkey % 2 = 0").select("source_kind", raw.alias("source_raw")))


_UNION = {"resource": ("lineitem", "l_orderkey", "l_returnflag"), "data": ("orders", "o_orderkey", "o_orderpriority"), "provider": ("supplier", "s_suppkey", "s_name"), "module": ("customer", "c_custkey", "c_name"), "variable": ("part", "p_partkey", "p_name"), "local": ("nation", "n_nationkey", "n_name"), "output": ("region", "r_regionkey", "r_name")}


@over(" UNION ALL ".join(f"SELECT '{k}' AS kind, {a}::BIGINT AS id, {b} AS name, '' AS account_id FROM {t}" for k, (t, a, b) in _UNION.items()))
def seven_kind_union(t):
    out = None
    for k, (name, a, b) in _UNION.items():
        part = getattr(t, name).select(F.lit(k).alias("kind"), long(a).alias("id"), F.col(b).alias("name"), F.lit("").alias("account_id"))
        out = part if out is None else out.unionByName(part)
    return out


@over("SELECT doc_id, CASE WHEN strlen(text) > 4000 THEN 'TF1201' ELSE 'ok' END AS code FROM documents")
def limit_caps(t):
    return t.documents.select("doc_id", F.when(F.octet_length("text") > 4000, "TF1201").otherwise("ok").alias("code"))


@over("WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS u, (n_nationkey * 7 + 3)::BIGINT % 25 AS v FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation), r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT v, depth + 1 FROM r JOIN e ON node = u WHERE depth < 4) SELECT 0::BIGINT AS start, node, min(depth)::INT AS depth FROM r GROUP BY 2")
def reachability(t):
    n = t.nation.select(long("n_nationkey").alias("u"))
    e = n.select("u", ((F.col("u") * 7 + 3) % 25).alias("v")).unionByName(n.select("u", ((F.col("u") + 5) % 25).alias("v"))).distinct()
    return edges.reachable(e, n.filter("u = 0").select(F.col("u").alias("start")), 4)


@over("""WITH have AS (SELECT DISTINCT 'src' || (n_nationkey % 20) AS dir FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'src' || n_nationkey || '/fr' FROM nation)
SELECT doc_id, coalesce((SELECT max(dir) FROM have WHERE dir = source || '/' || lang), (SELECT max(dir) FROM have WHERE dir = source)) AS found FROM documents""")
def find_in_parents(t):
    """The nearest ancestor directory, itself included, that has the wanted file."""
    have = t.nation.filter("n_nationkey % 2 = 0").select(F.concat(F.lit("src"), F.col("n_nationkey") % 20).alias("dir")).unionByName(t.nation.select(F.concat(F.lit("src"), "n_nationkey", F.lit("/fr")).alias("dir"))).distinct()
    d = t.documents.select("doc_id", F.split(F.concat_ws("/", "source", "lang"), "/").alias("p"))
    up = d.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice("p", 1, n), "/").alias("dir")))).alias("a")).select("doc_id", "a.*")
    return up.join(have.withColumn("hit", F.lit(True)), "dir", "left").groupBy("doc_id").agg(F.max_by(F.when(F.col("hit"), F.col("dir")), F.when(F.col("hit"), F.col("depth"))).alias("found"))


@over(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t, _, _ in _UNION.values()))
def manifest_rows(t):
    out = None
    for name, _, _ in _UNION.values():
        part = getattr(t, name).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@over("SELECT count(*) AS total_rows, sum(n_chars)::BIGINT AS total_bytes FROM documents")
def report_totals(t):
    return t.documents.agg(F.count(F.lit(1)).alias("total_rows"), F.sum("n_chars").alias("total_bytes"))


@over("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lpad(s_suppkey::VARCHAR, 12, '0') END AS account FROM supplier")
def role_accounts(t):
    arn = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("arn:aws:iam::"), F.lpad(F.col("s_suppkey").cast("string"), 12, "0"), F.lit(":role/x"))).otherwise(F.lit("arn:aws:s3:::x"))
    return t.supplier.select("s_suppkey", C.account_of_role(arn).alias("account"))
