"""The registered queries of the language engine, with their oracle SQL.

Each entry is a query in the engine's language and the same question in DuckDB's SQL.  Floating sums are
rounded on both sides, since the order of addition differs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestq.session import Session
from nestq.sources.ion import read_graph, write_ion

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_ENTRIES: dict[str, tuple[str, str, dict]] = {}


def entry(name: str, query: str, oracle: str, **options) -> None:
    _ENTRIES[name] = (query, oracle, options)


def session(spark: SparkSession, sf_dir: str, **options) -> Session:
    """A session over the tables of a directory, with nested, dynamic and graph views of them."""
    s = Session(spark, **options).register_directory(sf_dir, TABLES)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def nested() -> DataFrame:
        item = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
        items = read("lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
        return read("orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "items")

    def dynamic() -> DataFrame:
        return read("events").select("event_id", "event_type", "value", F.parse_json("props").alias("props"))

    def mixed() -> DataFrame:
        return read("events").select("event_id", F.parse_json(F.expr("case event_id % 5 when 0 then '{\"a\": null}' when 1 then '{\"a\": 1}' when 2 then '{\"a\": \"x\"}' when 3 then '{\"b\": true}' else '{\"a\": [1, 2, {\"c\": 7}]}' end")).alias("doc"))

    def varied() -> DataFrame:
        """A value of another type for each remainder by 8: integer, decimal, string, boolean, null, list, digits in a string, absent."""
        kinds = "cast(event_id as string)", "event_id || '.5'", "'\"s' || event_id || '\"'", "cast(event_id % 16 = 3 as string)", "'null'", "'[' || event_id || ']'", "'\"' || event_id || '\"'"
        cases = " ".join(f"when {k} then {sql}" for k, sql in enumerate(kinds))
        return read("events").select("event_id", F.parse_json(F.expr(f"case event_id % 8 {cases} end")).alias("v"))

    s.register("varied_events", varied)
    s.register("nested_orders", nested).register("dynamic_events", dynamic).register("mixed_events", mixed).register("zoned_events", lambda: zoned(read("events")))
    return s


def zoned(events: DataFrame) -> DataFrame:
    """Events with their time as a zoned value: the instant and the offset in which it was written."""
    at = F.struct(F.col("ts").alias("ts"), F.lit(-7).alias("tz_hour"), F.lit(-30).alias("tz_minute"))
    return events.select("event_id", at.alias("at"))


def with_graph(s: Session, sf_dir: str) -> Session:
    """Graph ``world``: regions, nations and customers; directed ``in``, undirected ``peer``."""
    spark = s.spark

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def node(df: DataFrame, prefix: str, key: str, name: str, label: str) -> DataFrame:
        return df.select(F.concat(F.lit(prefix), F.col(key)).alias("id"), F.array(F.lit(label), F.lit("Place" if label != "Customer" else "Person")).alias("labels"), F.struct(F.col(key).cast("bigint").alias("k"), F.col(name).alias("name")).alias("payload"))

    nation, customer = read("nation"), read("customer")
    nodes = node(read("region"), "r", "r_regionkey", "r_name", "Region").unionByName(node(nation, "n", "n_nationkey", "n_name", "Nation")).unionByName(node(customer, "c", "c_custkey", "c_name", "Customer"))

    def edge(df: DataFrame, id_: str, src: F.Column, dst: F.Column, label: str, directed: bool, weight: F.Column) -> DataFrame:
        return df.select(F.concat(F.lit(id_), src, F.lit("_"), dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(directed).alias("directed"), F.array(F.lit(label)).alias("labels"), F.struct(weight.cast("bigint").alias("w")).alias("payload"))

    def of(prefix: str, c: str | F.Column) -> F.Column:
        return F.concat(F.lit(prefix), c if isinstance(c, F.Column) else F.col(c))

    edges = edge(customer, "a", of("c", "c_custkey"), of("n", "c_nationkey"), "in", True, F.col("c_nationkey"))
    edges = edges.unionByName(edge(nation, "b", of("n", "n_nationkey"), of("r", "n_regionkey"), "in", True, F.col("n_regionkey")))
    edges = edges.unionByName(edge(nation.where("n_nationkey < 20"), "p", of("n", "n_nationkey"), of("n", F.col("n_nationkey") + 5), "peer", False, F.col("n_nationkey")))
    return s.register_graph("world", nodes, edges)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for files that a query reads back, where driver and executors see it."""
    top = spark.conf.get("spark.checkpoint.dir", "")
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="nestq-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/nestq-files-{uuid.uuid4().hex}"


def numbered(df: DataFrame) -> DataFrame:
    """A sorted result with ``place``, its row numbers: rows before a partition, plus those before in it.

    The sorted rows are written once, with their partition and their place in it: a second evaluation may draw
    other bounds between partitions, and its counts would not be those of the rows that are numbered.
    """
    mask = (1 << 33) - 1
    path = shared_folder(df.sparkSession)
    rows = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mid", 33))
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_start")
    placed = rows.join(F.broadcast(starts), "_part")
    return placed.withColumn("place", F.col("_start") + F.col("_mid").bitwiseAND(F.lit(mask)) + 1).drop("_mid", "_part", "_start")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    query, _, options = _ENTRIES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir, **{k: v for k, v in options.items() if k in ("mode", "compat", "context")})
        if name.startswith("graph_"):
            with_graph(s, sf_dir)
        if prepare := options.get("prepare"):
            prepare(s, sf_dir)
        paths = options["files"](s, sf_dir) if "files" in options else {}
        df = s.sql(query.format(dir=sf_dir, **paths) if options.get("format") or paths else query)
        if options.get("numbered"):
            df = numbered(df)
        digits = options.get("digits", 4)
        return df.select(*(F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields))

    run.__name__ = name
    return run


# --- scans and projections ----------------------------------------------------------------------------
entry(
    "flagship",
    """SELECT l.l_returnflag, l.l_linestatus, SUM(l.l_quantity) AS sum_qty, SUM(l.l_extendedprice * (1 - l.l_discount)) AS revenue,
              AVG(l.l_extendedprice) AS avg_price, COUNT(*) AS n
       FROM lineitem AS l WHERE l.l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
       GROUP BY l.l_returnflag, l.l_linestatus ORDER BY l_returnflag, l_linestatus""",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
              round(avg(l_extendedprice), 2) AS avg_price, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY ALL""",
    digits=2,
)
entry("scan", "SELECT r.r_regionkey, r.r_name FROM region AS r", "SELECT r_regionkey, r_name FROM region")
entry("scan_at", "SELECT o.o_orderkey, i.l_partkey AS part, p FROM nested_orders AS o, o.items AS i AT p", "SELECT l_orderkey AS o_orderkey, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) - 1 AS p FROM lineitem")
entry("unpivot", "SELECT e.event_id, k, v FROM (SELECT x.event_id, {'one': x.event_id, 'two': x.event_id * 2} AS t FROM events AS x) AS e, UNPIVOT e.t AS v AT k", "SELECT event_id, 'one' AS k, event_id AS v FROM events UNION ALL SELECT event_id, 'two', event_id * 2 FROM events")
entry("unpivot_variant", "SELECT e.event_id, k FROM dynamic_events AS e, UNPIVOT e.props AS v AT k", "SELECT event_id, unnest(json_keys(props)) AS k FROM events")
entry("project", "SELECT n.n_name AS name, n.n_nationkey + 1 AS next FROM nation AS n", "SELECT n_name AS name, CAST(n_nationkey + 1 AS BIGINT) AS next FROM nation")
entry("project_alias", "SELECT n.n_name, n.n_nationkey * 2, n_regionkey FROM nation AS n", "SELECT n_name, CAST(n_nationkey * 2 AS BIGINT) AS _2, n_regionkey FROM nation")
entry("select_star", "SELECT * FROM nation AS n, region AS r WHERE n.n_regionkey = r.r_regionkey", "SELECT * FROM nation, region WHERE n_regionkey = r_regionkey")
entry("select_star_unpivot", "SELECT * FROM UNPIVOT {'width': 12.25, 'height': 80.5, 'depth': 7.75} AS size AT side", "SELECT CAST(12.25 AS DECIMAL(4,2)) AS size, 'width' AS side UNION ALL SELECT 80.5, 'height' UNION ALL SELECT 7.75, 'depth'")
entry("select_value", "SELECT VALUE {'key': p.p_partkey, 'big': p.p_size > 25} FROM part AS p", "SELECT p_partkey AS key, p_size > 25 AS big FROM part")
entry("select_value_scalar", "SELECT VALUE p.p_size + 1 FROM part AS p", "SELECT CAST(p_size + 1 AS BIGINT) AS _1 FROM part")
entry("pivot", "SELECT t.NATION_1 AS one, t.NATION_2 AS two FROM (SELECT (PIVOT n.n_nationkey AT n.n_name FROM nation AS n) AS t FROM [1] AS x) AS q", "SELECT max(n_nationkey) FILTER (n_name = 'NATION_1') AS one, max(n_nationkey) FILTER (n_name = 'NATION_2') AS two FROM nation")
entry("distinct", "SELECT DISTINCT l.l_returnflag, l.l_linestatus FROM lineitem AS l", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
entry("expr_query", "2 * 3 + 1", "SELECT CAST(7 AS BIGINT) AS _1")
entry("from_first", "FROM supplier AS s WHERE s.s_acctbal > 0 SELECT s.s_suppkey, s.s_name", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
entry("exclude", "SELECT * EXCLUDE n_name FROM nation AS n", "SELECT n_nationkey, n_regionkey FROM nation")
entry("exclude_nested", "SELECT o.o_orderkey, COLL_COUNT(o.items) AS c, i.l_partkey AS p FROM (SELECT * EXCLUDE x.items[*].l_quantity FROM nested_orders AS x) AS o, o.items AS i", "SELECT l_orderkey AS o_orderkey, count(*) OVER (PARTITION BY l_orderkey) AS c, l_partkey AS p FROM lineitem")
entry("select_tstar", "SELECT r.*, n.n_name FROM region AS r JOIN nation AS n ON n.n_regionkey = r.r_regionkey", "SELECT r.*, n_name FROM region r JOIN nation ON n_regionkey = r_regionkey")
entry("let", "SELECT d, COUNT(*) AS n FROM lineitem AS l LET l.l_linenumber * 2 AS d GROUP BY d", "SELECT CAST(l_linenumber * 2 AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1")
entry("values", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a'), (2, 'b')) AS t(_1, _2)")
entry("table_stmt", "TABLE region", "SELECT * FROM region")
# --- predicates ---------------------------------------------------------------------------------------
entry("filter", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem AS l WHERE l.l_quantity > 45 AND l.l_returnflag = 'R'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
entry("having", "SELECT o.o_custkey AS c, COUNT(*) AS n FROM orders AS o GROUP BY o.o_custkey HAVING COUNT(*) > 12", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
entry("and_or", "SELECT p.p_partkey, (p.p_size > 10 AND NULL) AS a, (p.p_size > 10 OR NULL) AS o FROM part AS p WHERE p.p_size > 40 OR p.p_size < 5", "SELECT p_partkey, (p_size > 10 AND NULL) AS a, (p_size > 10 OR NULL) AS o FROM part WHERE p_size > 40 OR p_size < 5")
entry("not", "SELECT p.p_partkey FROM part AS p WHERE NOT (p.p_size > 10)", "SELECT p_partkey FROM part WHERE NOT p_size > 10")
entry("compare", "SELECT p.p_partkey, p.p_size = 10 AS a, p.p_size <> 10 AS b, p.p_size < 10 AS c, p.p_size >= 10.5 AS d, p.p_size = 'x' AS e, p.p_size < 'x' AS f FROM part AS p", "SELECT p_partkey, p_size = 10 AS a, p_size <> 10 AS b, p_size < 10 AS c, p_size >= 10.5 AS d, false AS e, CAST(NULL AS BOOLEAN) AS f FROM part")
entry("between", "SELECT p.p_partkey FROM part AS p WHERE p.p_size BETWEEN 5 AND 8 OR p.p_size NOT BETWEEN 2 AND 45", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 8 OR p_size NOT BETWEEN 2 AND 45")
entry("in_list", "SELECT p.p_partkey, p.p_size IN (1, 2, NULL) AS a FROM part AS p WHERE p.p_brand NOT IN ['Brand#11', 'Brand#12']", "SELECT p_partkey, p_size IN (1, 2, NULL) AS a FROM part WHERE p_brand NOT IN ('Brand#11', 'Brand#12')")
entry("in_subquery", "SELECT c.c_custkey FROM customer AS c WHERE c.c_custkey IN (SELECT o.o_custkey FROM orders AS o WHERE o.o_totalprice > 300000)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
entry("in_subquery_projected", "SELECT c.c_custkey, c.c_custkey IN (SELECT VALUE CASE WHEN o.o_orderkey = 1 THEN NULL ELSE o.o_custkey END FROM orders AS o) AS a FROM customer AS c", "SELECT c_custkey, c_custkey IN (SELECT CASE WHEN o_orderkey = 1 THEN NULL ELSE o_custkey END FROM orders) AS a FROM customer")
entry("in_nested", "SELECT o.o_orderkey FROM nested_orders AS o WHERE 7 IN (SELECT VALUE i.l_linenumber FROM o.items AS i)", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_linenumber = 7")
entry("like", "SELECT p.p_partkey FROM part AS p WHERE p.p_name LIKE 's%' OR p.p_name LIKE '%_o%t'", "SELECT p_partkey FROM part WHERE p_name LIKE 's%' OR p_name LIKE '%_o%t'")
entry("like_many", "SELECT COUNT(*) AS n FROM documents AS d WHERE " + " OR ".join(f"d.text LIKE '%{w}%'" for w in ("the th", "and ", "of an", "queai", "verung", "ciónmente", "password", "AKIA", "MIT", "heit", "êch", "llez", "onhe", "zq", "ßch")), "SELECT count(*) AS n FROM documents WHERE " + " OR ".join(f"text LIKE '%{w}%'" for w in ("the th", "and ", "of an", "queai", "verung", "ciónmente", "password", "AKIA", "MIT", "heit", "êch", "llez", "onhe", "zq", "ßch")))
entry("like_dynamic", "SELECT n.n_nationkey FROM nation AS n, region AS r WHERE r.r_name LIKE '%' || SUBSTRING(n.n_name, 1, 1) || '%' AND n.n_regionkey = r.r_regionkey", "SELECT n_nationkey FROM nation, region WHERE r_name LIKE '%' || substring(n_name, 1, 1) || '%' AND n_regionkey = r_regionkey")
entry("like_escape", "SELECT n.n_nationkey FROM nation AS n WHERE n.n_name LIKE 'NATION!_1%' ESCAPE '!'", "SELECT n_nationkey FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
entry("is_null", "SELECT d.doc_id, l.quality IS NULL AS a, l.quality IS NOT NULL AS b FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id", "SELECT d.doc_id, quality IS NULL AS a, quality IS NOT NULL AS b FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
entry("is_missing", "SELECT e.event_id, e.doc.a IS MISSING AS m, e.doc.a IS NULL AS n FROM mixed_events AS e", "SELECT event_id, event_id % 5 = 3 AS m, event_id % 5 IN (0, 3) AS n FROM events")
entry("is_type", "SELECT e.event_id, e.doc.a IS INT AS i, e.doc.a IS STRING AS s, e.doc.a IS LIST AS l FROM mixed_events AS e", "SELECT event_id, event_id % 5 = 1 AS i, event_id % 5 = 2 AS s, event_id % 5 = 4 AS l FROM events")
entry("exists", "SELECT c.c_custkey FROM customer AS c WHERE EXISTS(SELECT o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
# --- joins --------------------------------------------------------------------------------------------
entry("cross_join", "SELECT r.r_name, n.n_name FROM region AS r CROSS JOIN nation AS n", "SELECT r_name, n_name FROM region CROSS JOIN nation")
entry("inner_join_equi", "SELECT o.o_orderkey, l.l_linenumber, o.o_orderstatus FROM orders AS o JOIN lineitem AS l ON o.o_orderkey = l.l_orderkey", "SELECT o_orderkey, l_linenumber, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
entry("inner_join_theta", "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s JOIN nation AS n ON s.s_nationkey < n.n_nationkey", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey")
entry("left_join", "SELECT d.doc_id, l.toxic FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id", "SELECT d.doc_id, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
entry("right_join", "SELECT d.doc_id, l.toxic FROM labels AS l RIGHT JOIN documents AS d ON d.doc_id = l.doc_id", "SELECT d.doc_id, toxic FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
entry("full_join", "SELECT c.c_custkey, s.s_suppkey FROM customer AS c FULL JOIN supplier AS s ON c.c_custkey = s.s_suppkey * 10", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 10")
entry("lateral_join", "SELECT o.o_orderkey, i.l_linenumber FROM nested_orders AS o, o.items AS i WHERE i.l_quantity > 40", "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
entry("lateral_left_join", "SELECT o.o_orderkey, i.l_linenumber FROM nested_orders AS o LEFT JOIN o.items AS i ON i.l_quantity > 49", "SELECT o.k AS o_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) o LEFT JOIN lineitem ON l_orderkey = o.k AND l_quantity > 49")
entry("join_using", "SELECT doc_id, toxic, lang FROM documents JOIN labels USING (doc_id)", "SELECT doc_id, toxic, lang FROM documents JOIN labels USING (doc_id)")
entry("natural_join", "SELECT * FROM (SELECT doc_id, lang FROM documents) AS d NATURAL JOIN labels AS l", "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
entry("subquery_from", "SELECT x.c, x.n FROM (SELECT o.o_custkey AS c, COUNT(*) AS n FROM orders AS o GROUP BY o.o_custkey) AS x WHERE x.n > 10", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 10")
entry("subquery_lateral", "SELECT c.c_custkey, x.n FROM customer AS c, (SELECT COUNT(*) AS n FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS x", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
entry("subquery_select", "SELECT c.c_custkey, COLL_COUNT(x.ks) AS n FROM (SELECT c.c_custkey, (SELECT VALUE o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS ks FROM customer AS c) AS x, [x] AS c", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
entry("subquery_scalar", "SELECT p.p_partkey FROM part AS p WHERE p.p_retailprice > (SELECT AVG(q.p_retailprice) FROM part AS q)", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
entry("semi_join", "SELECT s.s_suppkey FROM supplier AS s WHERE EXISTS(SELECT 1 FROM lineitem AS l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)", "SELECT s_suppkey FROM supplier SEMI JOIN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) ON l_suppkey = s_suppkey")
entry("anti_join", "SELECT c.c_custkey FROM customer AS c WHERE NOT EXISTS(SELECT 1 FROM orders AS o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey")
entry("cte", "WITH big AS (SELECT o.o_custkey AS c, o.o_totalprice AS p FROM orders AS o WHERE o.o_totalprice > 400000) SELECT b.c, COUNT(*) AS n FROM big AS b GROUP BY b.c", "SELECT o_custkey AS c, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
entry("cte_recursive", "WITH RECURSIVE steps(n) AS ((SELECT 1 AS n FROM [1] AS z) UNION ALL (SELECT s.n + 1 AS n FROM steps AS s WHERE s.n < 10)) SELECT s.n FROM steps AS s", "SELECT CAST(i AS BIGINT) AS n FROM range(1, 11) AS t(i)")
# --- aggregation --------------------------------------------------------------------------------------
entry("group_by", "SELECT p.p_brand, COUNT(*) AS n FROM part AS p GROUP BY p.p_brand", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1")
entry("group_by_expr", "SELECT l.l_linenumber % 2 AS odd, COUNT(*) AS n FROM lineitem AS l GROUP BY l.l_linenumber % 2", "SELECT CAST(l_linenumber % 2 AS BIGINT) AS odd, count(*) AS n FROM lineitem GROUP BY 1")
entry("group_as", "SELECT k, COLL_SUM(SELECT VALUE x.n.n_nationkey FROM g AS x) AS s, COLL_COUNT(g) AS c FROM nation AS n GROUP BY n.n_regionkey AS k GROUP AS g", "SELECT n_regionkey AS k, CAST(sum(n_nationkey) AS BIGINT) AS s, count(*) AS c FROM nation GROUP BY 1")
entry("global_agg", "SELECT SUM(l.l_quantity) AS q, COUNT(l.l_orderkey) AS n FROM lineitem AS l", "SELECT round(sum(l_quantity), 4) AS q, count(l_orderkey) AS n FROM lineitem")
entry("agg_count", "SELECT COUNT(l.quality) AS n FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id", "SELECT count(quality) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
entry("agg_count_star", "SELECT COUNT(*) AS n FROM events AS e", "SELECT count(*) AS n FROM events")
entry("agg_sum", "SELECT e.event_type, SUM(e.event_id) AS s FROM events AS e GROUP BY e.event_type", "SELECT event_type, CAST(sum(event_id) AS BIGINT) AS s FROM events GROUP BY 1")
entry("agg_avg", "SELECT p.p_brand, AVG(p.p_size) AS a FROM part AS p GROUP BY p.p_brand", "SELECT p_brand, round(avg(p_size), 4) AS a FROM part GROUP BY 1")
entry("agg_min_max", "SELECT e.event_type, MIN(e.ts) AS a, MAX(e.user_id) AS b, MIN(e.value) AS c, MAX(e.value) AS d FROM events AS e GROUP BY e.event_type", "SELECT event_type, min(ts) AS a, max(user_id) AS b, round(min(value), 4) AS c, round(max(value), 4) AS d FROM events GROUP BY 1")
entry("agg_any", "SELECT p.p_brand, ANY(p.p_size > 45) AS a, SOME(p.p_size > 60) AS s FROM part AS p GROUP BY p.p_brand", "SELECT p_brand, bool_or(p_size > 45) AS a, bool_or(p_size > 60) AS s FROM part GROUP BY 1")
entry("agg_every", "SELECT p.p_brand, EVERY(p.p_size > 2) AS e FROM part AS p GROUP BY p.p_brand", "SELECT p_brand, bool_and(p_size > 2) AS e FROM part GROUP BY 1")
entry("agg_all", "SELECT l.l_returnflag AS f, COUNT(l.l_partkey) AS c, SUM(l.l_partkey) AS s, AVG(l.l_partkey) AS a, MIN(l.l_partkey) AS i, MAX(l.l_partkey) AS x FROM lineitem AS l GROUP BY l.l_returnflag", "SELECT l_returnflag AS f, count(l_partkey) AS c, CAST(sum(l_partkey) AS BIGINT) AS s, round(avg(l_partkey), 4) AS a, min(l_partkey) AS i, max(l_partkey) AS x FROM lineitem GROUP BY 1")
entry("agg_distinct", "SELECT l.l_returnflag AS f, COUNT(DISTINCT l.l_partkey) AS c, SUM(DISTINCT l.l_partkey) AS s, AVG(DISTINCT l.l_partkey) AS a, MIN(DISTINCT l.l_partkey) AS i, MAX(DISTINCT l.l_partkey) AS x FROM lineitem AS l GROUP BY l.l_returnflag", "SELECT l_returnflag AS f, count(DISTINCT l_partkey) AS c, CAST(sum(DISTINCT l_partkey) AS BIGINT) AS s, round(avg(DISTINCT l_partkey), 4) AS a, min(l_partkey) AS i, max(l_partkey) AS x FROM lineitem GROUP BY 1")
entry("coll_count", "SELECT o.o_orderkey, COLL_COUNT(o.items) AS n FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("coll_sum", "SELECT o.o_orderkey, COLL_SUM(SELECT VALUE i.l_linenumber FROM o.items AS i) AS s FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("coll_avg", "SELECT v.vec_id, COLL_AVG(v.embedding) AS a FROM embeddings AS v", "SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS a FROM embeddings")
entry("coll_min_max", "SELECT v.vec_id, CAST(COLL_MIN(v.embedding) AS DOUBLE) AS lo, CAST(COLL_MAX(v.embedding) AS DOUBLE) AS hi FROM embeddings AS v", "SELECT vec_id, round(CAST(list_min(embedding) AS DOUBLE), 4) AS lo, round(CAST(list_max(embedding) AS DOUBLE), 4) AS hi FROM embeddings")
entry("coll_any", "SELECT o.o_orderkey, COLL_ANY(SELECT VALUE i.l_quantity > 45 FROM o.items AS i) AS a FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, bool_or(l_quantity > 45) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("coll_every", "SELECT o.o_orderkey, COLL_EVERY(SELECT VALUE i.l_quantity > 5 FROM o.items AS i) AS a FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, bool_and(l_quantity > 5) AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("coll_distinct", "SELECT o.o_orderkey, COLL_COUNT(DISTINCT (SELECT VALUE i.l_returnflag FROM o.items AS i)) AS n FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, count(DISTINCT l_returnflag) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("coll_subquery", "SELECT c.c_custkey, COLL_MAX(SELECT VALUE o.o_orderkey FROM orders AS o WHERE o.o_custkey = c.c_custkey) AS m FROM customer AS c", "SELECT c_custkey, (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer")
# --- sorting and limits -------------------------------------------------------------------------------
entry("order_by", "SELECT o.o_orderkey, o.o_totalprice FROM orders AS o ORDER BY o.o_totalprice DESC, o.o_orderkey", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
entry("order_by_nulls", "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id", "SELECT d.doc_id, quality, row_number() OVER (ORDER BY quality NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", numbered=True)
entry("order_by_default_nulls", "SELECT d.doc_id, l.quality FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id ORDER BY l.quality DESC, d.doc_id", "SELECT d.doc_id, quality, row_number() OVER (ORDER BY quality DESC NULLS FIRST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id", numbered=True)
entry("order_by_alias", "SELECT p.p_partkey, -p.p_size AS s FROM part AS p ORDER BY s, p.p_partkey", "SELECT p_partkey, -p_size AS s, row_number() OVER (ORDER BY -p_size, p_partkey) AS place FROM part", numbered=True)
entry("limit", "SELECT o.o_orderkey FROM orders AS o ORDER BY o.o_orderkey LIMIT 7", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7")
entry("offset", "SELECT o.o_orderkey FROM orders AS o ORDER BY o.o_orderkey LIMIT 7 OFFSET 5", "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 7 OFFSET 5")
entry("top_k", "SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice AS p FROM lineitem AS l ORDER BY p DESC, l.l_orderkey, l.l_linenumber LIMIT 10", "SELECT l_orderkey, l_linenumber, round(l_extendedprice, 4) AS p FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
entry("distinct_limit", "SELECT DISTINCT l.l_linenumber AS n FROM lineitem AS l ORDER BY n LIMIT 3", "SELECT DISTINCT l_linenumber AS n FROM lineitem ORDER BY n LIMIT 3")
# --- set operations -----------------------------------------------------------------------------------
entry("outer_union_all", "(SELECT n.n_name AS name, n.n_regionkey AS r FROM nation AS n) OUTER UNION ALL (SELECT r.r_name AS name FROM region AS r)", "SELECT n_name AS name, n_regionkey AS r FROM nation UNION ALL SELECT r_name, NULL FROM region")
entry("outer_union", "(SELECT n.n_regionkey AS k FROM nation AS n) OUTER UNION (SELECT r.r_regionkey AS k FROM region AS r)", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
entry("outer_intersect_all", "(SELECT n.n_regionkey AS k FROM nation AS n) OUTER INTERSECT ALL (SELECT n.n_nationkey % 3 AS k FROM nation AS n)", "SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation INTERSECT ALL SELECT n_nationkey % 3 FROM nation")
entry("outer_intersect", "(SELECT n.n_regionkey AS k FROM nation AS n) OUTER INTERSECT (SELECT s.s_nationkey AS k FROM supplier AS s)", "SELECT n_regionkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
entry("outer_except_all", "(SELECT n.n_regionkey AS k FROM nation AS n) OUTER EXCEPT ALL (SELECT r.r_regionkey AS k FROM region AS r)", "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region")
entry("outer_except", "(SELECT n.n_regionkey AS k FROM nation AS n) OUTER EXCEPT (SELECT r.r_regionkey AS k FROM region AS r)", "SELECT DISTINCT k FROM (SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region)")
entry("union", "(SELECT c.c_nationkey AS k FROM customer AS c) UNION (SELECT s.s_nationkey AS k FROM supplier AS s)", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
entry("union_all", "(SELECT c.c_nationkey AS k FROM customer AS c) UNION ALL (SELECT s.s_nationkey AS k FROM supplier AS s)", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
entry("intersect", "(SELECT c.c_nationkey AS k FROM customer AS c) INTERSECT (SELECT s.s_nationkey AS k FROM supplier AS s)", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
entry("except", "(SELECT n.n_nationkey AS k FROM nation AS n) EXCEPT (SELECT s.s_nationkey AS k FROM supplier AS s)", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
# --- scalars ------------------------------------------------------------------------------------------
for _name, _q, _o in (
    ("arith_add", "p.p_size + 1", "CAST(p_size + 1 AS BIGINT)"), ("arith_sub", "p.p_size - 1.5", "CAST(p_size - 1.5 AS DECIMAL(38,1))"), ("arith_mul", "p.p_size * p.p_partkey", "CAST(p_size * p_partkey AS BIGINT)"),
    ("arith_div", "(p.p_size - 25) / 2", "CAST((p_size - 25) // 2 AS BIGINT)"), ("arith_div_zero", "p.p_size / (p.p_size - p.p_size)", "CAST(NULL AS BIGINT)"), ("arith_mod", "(p.p_size - 25) % 3", "CAST((p_size - 25) % 3 AS BIGINT)"),
    ("fn_mod", "MOD(p.p_partkey, 7)", "CAST(p_partkey % 7 AS BIGINT)"), ("arith_pow", "p.p_size ^ 2", "round(pow(p_size, 2), 4)"), ("arith_neg", "-p.p_size", "-p_size"), ("arith_mismatch", "p.p_size + p.p_name IS NULL", "true"),
    ("fn_abs", "ABS(p.p_size - 25)", "CAST(abs(p_size - 25) AS BIGINT)"), ("fn_lower", "LOWER(p.p_brand)", "lower(p_brand)"), ("fn_upper", "UPPER(p.p_name)", "upper(p_name)"), ("fn_char_length", "CHAR_LENGTH(p.p_name)", "length(p_name)"),
    ("fn_octet_length", "OCTET_LENGTH(p.p_name) + BIT_LENGTH(p.p_name)", "CAST(strlen(p_name) + bit_length(p_name) AS BIGINT)"), ("fn_trim", "TRIM(BOTH 'sBt' FROM p.p_name) || TRIM(LEADING 'B' FROM p.p_brand)", "trim(p_name, 'sBt') || ltrim(p_brand, 'B')"),
    ("fn_substring", "SUBSTRING(p.p_name, 0, 3) || '-' || SUBSTRING(p.p_name FROM 3) || '-' || SUBSTRING(p.p_name FROM 2 FOR 2)", "substring(p_name, 1, 2) || '-' || substring(p_name, 3) || '-' || substring(p_name, 2, 2)"),
    ("fn_position", "POSITION('e' IN p.p_name)", "CAST(position('e' IN p_name) AS BIGINT)"), ("fn_overlay", "OVERLAY(p.p_name PLACING 'zz' FROM 2 FOR 3)", "substring(p_name, 1, 1) || 'zz' || substring(p_name, 5)"), ("fn_concat", "p.p_brand || '/' || p.p_type", "p_brand || '/' || p_type"),
    ("case_searched", "CASE WHEN p.p_size > 30 THEN 'big' WHEN p.p_size > 10 THEN 'mid' END", "CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' END"), ("case_simple", "CASE p.p_size WHEN 1 THEN 'one' WHEN 'x' THEN 'x' ELSE 'many' END", "CASE p_size WHEN 1 THEN 'one' ELSE 'many' END"),
    ("fn_coalesce", "COALESCE(NULL, MISSING, p.p_name)", "p_name"), ("fn_nullif", "NULLIF(p.p_size, 10)", "nullif(p_size, 10)"), ("cast", "CAST(p.p_size AS STRING) || CAST('12' AS INT)", "CAST(p_size AS VARCHAR) || '12'"), ("literals", "COALESCE(1e1, 0) + 2.5", "CAST(12.5 AS DOUBLE)"),
):
    entry(_name, f"SELECT p.p_partkey, {_q} AS x FROM part AS p", f"SELECT p_partkey, {_o} AS x FROM part")
entry("fn_extract_date", "SELECT o.o_orderkey, EXTRACT(YEAR FROM o.o_orderdate) AS y, EXTRACT(MONTH FROM o.o_orderdate) AS m, EXTRACT(DAY FROM o.o_orderdate) AS d FROM orders AS o", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders")
entry("fn_extract_time", "SELECT e.event_id, EXTRACT(HOUR FROM e.ts) AS h, EXTRACT(MINUTE FROM e.ts) AS m FROM events AS e", "SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events")
entry("fn_extract_second", "SELECT e.event_id, CAST(EXTRACT(SECOND FROM e.ts) AS DOUBLE) AS s FROM events AS e", "SELECT event_id, round(extract(microseconds FROM ts) / 1e6, 6) AS s FROM events", digits=6)
entry("fn_extract_tz", "SELECT e.event_id, EXTRACT(TIMEZONE_HOUR FROM e.at) AS h, EXTRACT(TIMEZONE_MINUTE FROM e.at) AS m, EXTRACT(HOUR FROM e.at) AS local FROM zoned_events AS e", "SELECT event_id, CAST(-7 AS BIGINT) AS h, CAST(-30 AS BIGINT) AS m, hour(ts - INTERVAL 450 MINUTE) AS local FROM events")
entry("date_literal", "SELECT o.o_orderkey FROM orders AS o WHERE o.o_orderdate < DATE '1995-01-01'", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-01'")
# --- nested and dynamic values --------------------------------------------------------------------------
entry("path_key", "SELECT e.event_id, CAST(e.props.k AS INT) AS k, e.props['k'] IS MISSING AS m FROM dynamic_events AS e", "SELECT event_id, CAST(props::json->>'$.k' AS BIGINT) AS k, false AS m FROM events")
entry("path_index", "SELECT v.vec_id, CAST(v.embedding[0] AS DOUBLE) AS a, v.embedding[100000] IS NULL AS b FROM embeddings AS v", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 4) AS a, true AS b FROM embeddings")
entry("path_expr", "SELECT v.vec_id, CAST(v.embedding[v.label % 4] AS DOUBLE) AS a FROM embeddings AS v", "SELECT vec_id, round(CAST(embedding[label % 4 + 1] AS DOUBLE), 4) AS a FROM embeddings")
entry("path_wildcard", "SELECT o.o_orderkey, COLL_SUM(o.items[*].l_linenumber) AS s FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("path_deep", "SELECT e.event_id, CAST(e.doc.a[2].c AS INT) AS c FROM mixed_events AS e", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN CAST(7 AS BIGINT) END AS c FROM events")
entry("ctor_tuple", "SELECT x.t.a AS a, x.t.b.c AS c FROM (SELECT {'a': p.p_size, 'b': {'c': p.p_brand}} AS t FROM part AS p) AS x", "SELECT p_size AS a, p_brand AS c FROM part")
entry("ctor_list", "SELECT p.p_partkey, x FROM part AS p, [p.p_size, p.p_size + 1] AS x", "SELECT p_partkey, unnest([CAST(p_size AS BIGINT), p_size + 1]) AS x FROM part")
entry("ctor_bag", "SELECT p.p_partkey, x FROM part AS p, <<p.p_brand, p.p_type>> AS x", "SELECT p_partkey, unnest([p_brand, p_type]) AS x FROM part")
entry("fn_cardinality", "SELECT o.o_orderkey, CARDINALITY(o.items) AS a, CARDINALITY({'x': 1, 'y': 2}) AS b FROM nested_orders AS o", "SELECT l_orderkey AS o_orderkey, count(*) AS a, CAST(2 AS BIGINT) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
entry("fn_tupleunion", "SELECT VALUE TUPLEUNION({'a': p.p_size}, {'b': p.p_brand}) FROM part AS p", "SELECT p_size AS a, p_brand AS b FROM part")
entry("fn_tupleconcat", "SELECT VALUE TUPLECONCAT({'a': p.p_size, 'b': 1}, {'b': p.p_brand}) FROM part AS p", "SELECT p_size AS a, p_brand AS b FROM part")
entry("group_variant", "SELECT e.props.k AS k, COUNT(*) AS n FROM dynamic_events AS e GROUP BY CAST(e.props.k AS INT) AS k", "SELECT CAST(props::json->>'$.k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
_ENTRIES["group_variant"] = ("SELECT k, COUNT(*) AS n FROM dynamic_events AS e GROUP BY CAST(e.props.k AS INT) AS k", *_ENTRIES["group_variant"][1:])


def _udf(s: Session, _: str) -> None:
    s.register_function("TWICE", "bigint", sql="2 * {0}")
    s.register_table_function("COUNTED", lambda session, n: session.spark.range(n).select(F.col("id").alias("foo"), F.concat(F.lit(session.context["prefix"]), F.col("id")).alias("bar")))


entry("udf", "SELECT p.p_partkey, TWICE(p.p_size) AS x FROM part AS p", "SELECT p_partkey, CAST(2 * p_size AS BIGINT) AS x FROM part", prepare=_udf)
entry("udtf_context", "SELECT t.foo, t.bar FROM COUNTED(5) AS t", "SELECT CAST(i AS BIGINT) AS foo, 'id_' || i AS bar FROM range(5) AS t(i)", prepare=_udf, context={"prefix": "id_"})
# --- graphs -------------------------------------------------------------------------------------------
entry("graph_node", "SELECT m.x.k AS k FROM (world MATCH (x:Region)) AS m", "SELECT CAST(r_regionkey AS BIGINT) AS k FROM region")
entry("graph_triple", "SELECT m.c.k AS c, m.n.name AS n FROM (world MATCH (c:Customer)-[e:in]->(n:Nation)) AS m", "SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
entry("graph_directions", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)~[e:peer]~(b:Nation)) AS m", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 5 AS BIGINT) AS b FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 5, n_nationkey FROM nation WHERE n_nationkey < 20")
entry("graph_left", "SELECT m.r.k AS r, m.n.k AS n FROM (world MATCH (r:Region)<-[e]-(n)) AS m", "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(n_nationkey AS BIGINT) AS n FROM nation")
entry("graph_labels", "SELECT m.x.name AS name FROM (world MATCH (x:!Customer&(Region|Nation))) AS m", "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation")
entry("graph_where", "SELECT m.c.k AS k FROM (world MATCH (c:Customer)-[e:in WHERE e.w > 20]->(n WHERE n.k < 24)) AS m", "SELECT c_custkey AS k FROM customer WHERE c_nationkey > 20 AND c_nationkey < 24")
entry("graph_path_where", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)-[:in]->(r)<-[:in]-(b:Nation) WHERE a.k < b.k) AS m", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
entry("graph_path", "SELECT m.r.name AS r, COUNT(*) AS n FROM (world MATCH (c:Customer)-[:in]->(n)-[:in]->(r:Region)) AS m GROUP BY m.r.name AS r", "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
_ENTRIES["graph_path"] = ("SELECT r, COUNT(*) AS n FROM (world MATCH (c:Customer)-[:in]->(n)-[:in]->(r:Region)) AS m GROUP BY m.r.name AS r", *_ENTRIES["graph_path"][1:])
entry("graph_cycle", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)~[e:peer]~(b:Nation)~[f:peer]~(a)) AS m", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 5 AS BIGINT) AS b FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 5, n_nationkey FROM nation WHERE n_nationkey < 20")
entry("graph_modes", "SELECT m.a.k AS a, m.c.k AS c FROM (world MATCH TRAIL (a:Nation)~[e:peer]~(b:Nation)~[f:peer]~(c:Nation)) AS m", "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 10 AS BIGINT) AS c FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey + 10, n_nationkey FROM nation WHERE n_nationkey < 15")
entry("graph_quant", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH ACYCLIC (a:Nation)~[:peer]~{1,2}(b:Nation)) AS m", " UNION ALL ".join(f"SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + {d} AS BIGINT) AS b FROM nation WHERE n_nationkey + {d} BETWEEN 0 AND 24" for d in (5, -5, 10, -10)))


# --- dynamic values -------------------------------------------------------------------------------------
_K = "event_id % 8"
entry(
    "variant_arith",
    "SELECT e.event_id, CAST(e.v + 1 AS DOUBLE) AS plus, CAST(e.v * 2 AS DOUBLE) AS twice, CAST(-e.v AS DOUBLE) AS minus, CAST(e.v / 4 AS DOUBLE) AS quarter, CAST(7 % e.v AS DOUBLE) AS rest, (e.v + 1) IS MISSING AS gone, (e.v + 1) IS NULL AS nothing FROM varied_events AS e",
    f"""SELECT event_id, CAST(n + 1 AS DOUBLE) AS plus, CAST(n * 2 AS DOUBLE) AS twice, CAST(-n AS DOUBLE) AS minus,
               CAST(CASE WHEN {_K} = 0 THEN event_id // 4 ELSE n / 4 END AS DOUBLE) AS quarter, CASE WHEN n <> 0 THEN CAST(7 % n AS DOUBLE) END AS rest,
               {_K} NOT IN (0, 1, 4) AS gone, {_K} NOT IN (0, 1) AS nothing
        FROM (SELECT event_id, CASE {_K} WHEN 0 THEN event_id WHEN 1 THEN event_id + 0.5 END AS n FROM events)""",
)
entry(
    "variant_integers_stay",
    "SELECT e.event_id, (e.v + 9007199254740993) IS INTEGER AS whole, CAST(e.v + 9007199254740993 AS BIGINT) AS big FROM varied_events AS e WHERE e.event_id % 8 = 0",
    "SELECT event_id, true AS whole, event_id + 9007199254740993 AS big FROM events WHERE event_id % 8 = 0",
)
entry(
    "variant_agg",
    "SELECT e.event_id % 4 AS k, COUNT(e.v) AS n, CAST(SUM(e.v) AS DOUBLE) AS s, AVG(e.v) AS a, CAST(MIN(e.v) AS STRING) AS low, MAX(e.v) IS LIST AS list_last FROM varied_events AS e GROUP BY e.event_id % 4",
    f"""SELECT event_id % 4 AS k, count(CASE WHEN {_K} NOT IN (4, 7) THEN 1 END) AS n, CAST(sum(CASE WHEN {_K} = 0 THEN event_id END) AS DOUBLE) AS s, avg(CASE WHEN {_K} = 0 THEN event_id END) AS a,
               CASE event_id % 4 WHEN 0 THEN CAST(min(CASE WHEN {_K} = 0 THEN event_id END) AS VARCHAR) WHEN 1 THEN CAST(min(CASE WHEN {_K} = 1 THEN event_id END) AS VARCHAR) || '.5'
                    WHEN 2 THEN min(CASE WHEN {_K} = 6 THEN CAST(event_id AS VARCHAR) END) ELSE 'false' END AS low, event_id % 4 = 1 AS list_last
        FROM events GROUP BY event_id % 4""",
)
entry(
    "variant_order",
    "SELECT e.event_id FROM varied_events AS e ORDER BY e.v NULLS LAST, e.event_id",
    f"""SELECT event_id, row_number() OVER (ORDER BY CASE {_K} WHEN 3 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 6 THEN 4 WHEN 5 THEN 6 ELSE 9 END,
               CASE {_K} WHEN 3 THEN CAST(event_id % 16 = 3 AS DOUBLE) WHEN 0 THEN event_id WHEN 1 THEN event_id + 0.5 WHEN 5 THEN event_id END,
               CASE {_K} WHEN 2 THEN 's' || event_id WHEN 6 THEN CAST(event_id AS VARCHAR) END, event_id) AS place FROM events""",
    numbered=True,
)
entry(
    "variant_compare",
    "SELECT a.event_id, a.v = b.v AS same, a.v < b.v AS less FROM varied_events AS a JOIN varied_events AS b ON b.event_id = a.event_id + 1 OR (b.event_id = a.event_id + 2 AND a.event_id % 8 = 7) OR (b.event_id = a.event_id AND a.event_id % 8 = 0)",
    f"""SELECT a.event_id, CASE WHEN a.{_K} IN (4, 7) OR b.{_K} IN (4, 7) THEN NULL ELSE a.event_id = b.event_id END AS same,
               CASE WHEN a.{_K} = 0 AND b.{_K} IN (0, 1) THEN a.event_id < b.event_id END AS less
        FROM events a JOIN events b ON b.event_id = a.event_id + 1 OR (b.event_id = a.event_id + 2 AND a.event_id % 8 = 7) OR (b.event_id = a.event_id AND a.event_id % 8 = 0)""",
)
entry(
    "variant_strings",
    "SELECT e.event_id, UPPER(e.v) AS u, CHAR_LENGTH(e.v) AS n, e.v LIKE '1%' AS one FROM varied_events AS e",
    f"""SELECT event_id, upper(t) AS u, length(t) AS n, t LIKE '1%' AS one FROM (SELECT event_id, CASE {_K} WHEN 2 THEN 's' || event_id WHEN 6 THEN CAST(event_id AS VARCHAR) END AS t FROM events)""",
)
entry("bag_equal", "SELECT n.n_nationkey AS k, <<n.n_nationkey, n.n_regionkey, 3>> = <<3, n.n_regionkey, n.n_nationkey>> AS same, <<n.n_nationkey, 1>> = <<1, n.n_regionkey>> AS some, [n.n_nationkey, 1] = [1, n.n_nationkey] AS listed, [1] = <<1>> AS kinds FROM nation AS n", "SELECT n_nationkey AS k, true AS same, n_nationkey = n_regionkey AS some, n_nationkey = 1 AS listed, false AS kinds FROM nation")
entry("tuple_equal", "SELECT n.n_nationkey AS k, {'a': n.n_nationkey, 'b': n.n_name} = {'b': n.n_name, 'a': n.n_nationkey} AS same, {'a': n.n_nationkey, 'b': 1} = {'b': 1, 'a': n.n_regionkey} AS some, {'a': 1} = {'b': 1} AS other, {'a': n.n_nationkey} <> {'a': 2.0} AS two FROM nation AS n", "SELECT n_nationkey AS k, true AS same, n_nationkey = n_regionkey AS some, false AS other, n_nationkey <> 2 AS two FROM nation")
entry("distinct_order_by", "SELECT DISTINCT c.c_nationkey AS k FROM customer AS c ORDER BY c.c_acctbal DESC, c.c_custkey", "SELECT k, row_number() OVER (ORDER BY b DESC, c) AS place FROM (SELECT c_nationkey AS k, max(c_acctbal) AS b, arg_min(c_custkey, (-c_acctbal, c_custkey)) AS c FROM customer GROUP BY 1)", numbered=True)
entry("coll_mixed", "SELECT n.n_nationkey AS k, CAST(COLL_MAX([n.n_nationkey, n.n_name, true]) AS STRING) AS top, CAST(COLL_MIN([n.n_nationkey, n.n_name, 2.5]) AS DOUBLE) AS low, COLL_COUNT([n.n_name, 1, null]) AS n, CAST(COLL_SUM([n.n_nationkey, 'x']) AS DOUBLE) AS s FROM nation AS n", "SELECT n_nationkey AS k, n_name AS top, CAST(least(n_nationkey, 2.5) AS DOUBLE) AS low, 2 AS n, CAST(NULL AS DOUBLE) AS s FROM nation")
entry("cast_collection", "SELECT n.n_nationkey AS k, CAST(<<n.n_nationkey, 2>> AS LIST) = [n.n_nationkey, 2] AS listed, CAST([2, n.n_nationkey] AS BAG) = <<n.n_nationkey, 2>> AS bagged FROM nation AS n", "SELECT n_nationkey AS k, true AS listed, true AS bagged FROM nation")
# --- files, made of the tables and read back ------------------------------------------------------------
def _csv(s: Session, sf_dir: str) -> dict[str, str]:
    path = shared_folder(s.spark)
    s.spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    return {"csv": path}


def _ion(s: Session, sf_dir: str) -> dict[str, str]:
    path = shared_folder(s.spark)
    write_ion(s.spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.array("o_orderkey", "o_custkey").alias("keys")), path)
    return {"ion": path}


def _packed(codec: str) -> Callable[[Session, str], dict[str, str]]:
    def made(s: Session, sf_dir: str) -> dict[str, str]:
        plain, path = _ion(s, sf_dir)["ion"], shared_folder(s.spark)
        s.spark.read.text(plain).write.option("compression", codec).text(path)
        return {"ion": path}

    return made


def _graph_text(s: Session, sf_dir: str) -> None:
    """The fixed tables region and nation (30 rows) as a graph's text."""
    regions = s.spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    nations = s.spark.read.parquet(f"{sf_dir}/nation.parquet").collect()
    nodes = [f'{{id: r{r.r_regionkey}, labels: ["Region"], payload: {r.r_regionkey}}}' for r in regions] + [f'{{id: n{n.n_nationkey}, labels: ["Nation"], payload: {n.n_nationkey}}}' for n in nations]
    edges = [f'{{id: e{n.n_nationkey}, labels: ["in"], ends: (n{n.n_nationkey} -> r{n.n_regionkey})}}' for n in nations]
    read_graph(s, "atlas", f"$graph::{{nodes: [{', '.join(nodes)}], edges: [{', '.join(edges)}]}}")


class _Extension:
    """Two functions that come with load()."""

    def load(self, s: Session) -> None:
        s.register_function("BETWEEN_CAPS", "string", sql="concat('<', {0}, '>')")
        s.register_table_function("SQUARES", lambda session, n: session.spark.range(1, n + 1).select("id", (F.col("id") * F.col("id")).alias("square")))


def _failing(s: Session, sf_dir: str) -> None:
    def broken(session: Session, n: int) -> DataFrame:
        raise RuntimeError("no such source")

    s.register_table_function("BROKEN", broken)


entry("scan_csv", "SELECT c.c_custkey, c.c_name FROM scan_csv('{csv}') AS c WHERE c.c_mktsegment = 'BUILDING'", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'", files=_csv)
entry("read_ion", "SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus FROM read_ion('{ion}/part*') AS o", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders", files=_ion)
entry("read_ion_lines", "SELECT o.o_orderkey, o.o_orderstatus, o.keys[1] AS second FROM read_ion('{ion}', 'o_orderkey bigint, o_orderstatus string, keys array<bigint>', true) AS o", "SELECT o_orderkey, o_orderstatus, o_custkey AS second FROM orders", files=_ion)
entry("scan_ion", "SELECT CAST(o.v.o_orderkey AS BIGINT) AS k, CAST(o.v.keys[1] AS BIGINT) AS c FROM scan_ion('{ion}/part*') AS o", "SELECT o_orderkey AS k, o_custkey AS c FROM orders", files=_ion)
entry("ion_gzip", "SELECT o.o_orderstatus AS s, COUNT(*) AS n FROM read_ion('{ion}/part*') AS o GROUP BY o.o_orderstatus", "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1", files=_packed("gzip"))
entry("graph_text", "SELECT CAST(m.n AS BIGINT) AS n, CAST(m.r AS BIGINT) AS r FROM (atlas MATCH (n:Nation)-[e:in]->(r:Region)) AS m", "SELECT CAST(n_nationkey AS BIGINT) AS n, CAST(n_regionkey AS BIGINT) AS r FROM nation", prepare=_graph_text)
entry("graph_table", "SELECT t.c.k AS c, t.r.name AS r FROM GRAPH_TABLE(world MATCH (c:Customer)-[e:in]->(n:Nation)-[f:in]->(r:Region)) AS t", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_PEERS = "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_nationkey + 5 AS BIGINT) AS b, 'n' AS kind FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_nationkey + 5, n_nationkey, 'n' FROM nation WHERE n_nationkey < 20"
_IN = "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(n_regionkey AS BIGINT) AS b, 'r' AS kind FROM nation"
_OF = "SELECT CAST(n_nationkey AS BIGINT) AS a, CAST(c_custkey AS BIGINT) AS b, 'c' AS kind FROM nation JOIN customer ON c_nationkey = n_nationkey"
entry("graph_right_or_undirected", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)~[e]~>(b)) AS m", f"SELECT a, b FROM ({_PEERS} UNION ALL {_IN})")
entry("graph_left_or_undirected", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)<~[e]~(b)) AS m", f"SELECT a, b FROM ({_PEERS} UNION ALL {_OF})")
entry("graph_left_or_right", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)<-[e]->(b)) AS m", f"SELECT a, b FROM ({_IN} UNION ALL {_OF})")
entry("graph_any_direction", "SELECT m.a.k AS a, m.b.k AS b FROM (world MATCH (a:Nation)-[e]-(b)) AS m", f"SELECT a, b FROM ({_PEERS} UNION ALL {_IN} UNION ALL {_OF})")
# --- the rest of the surface ----------------------------------------------------------------------------
entry("extension", "SELECT q.id, q.square, BETWEEN_CAPS(r.r_name) AS name FROM SQUARES(3) AS q, region AS r", "SELECT i AS id, i * i AS square, '<' || r_name || '>' AS name FROM range(1, 4) t(i), region", prepare=lambda s, d: s.load(_Extension()))
entry("table_function_error", "SELECT r.r_name, b._1 FROM region AS r LEFT JOIN BROKEN(1) AS b ON true", "SELECT r_name, CAST(NULL AS VARCHAR) AS _1 FROM region", prepare=_failing)
entry("lateral_keyword", "SELECT o.o_orderkey, i.l_partkey AS part FROM nested_orders AS o, LATERAL o.items AS i", "SELECT l_orderkey AS o_orderkey, l_partkey AS part FROM lineitem")
entry("fn_substring_for", "SELECT p.p_partkey, SUBSTRING(p.p_name FROM 2 FOR 4) AS s FROM part AS p", "SELECT p_partkey, substring(p_name, 2, 4) AS s FROM part")
entry("time_literal", "SELECT r.r_regionkey, EXTRACT(HOUR FROM TIME '10:21:30') AS h, EXTRACT(MINUTE FROM TIME '10:21:30') AS m, EXTRACT(YEAR FROM TIMESTAMP '2021-03-04 05:06:07') AS y FROM region AS r", "SELECT r_regionkey, 10 AS h, 21 AS m, 2021 AS y FROM region")
entry("bit_hex_literal", "SELECT r.r_regionkey, X'4142' = X'4142' AS same, B'01000001' = X'41' AS bits FROM region AS r", "SELECT r_regionkey, true AS same, true AS bits FROM region")
entry("compat_decimal", "SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_quantity * 1.5 AS DOUBLE) AS q, (l.l_quantity * 1.5) IS DECIMAL AS exact FROM lineitem AS l", "SELECT l_orderkey, l_linenumber, round(l_quantity * 1.5, 4) AS q, true AS exact FROM lineitem", compat="reference")
entry("row_constructor", "SELECT v._1 AS a, v._2 AS b FROM (VALUES (1, 'x'), (2, 'y')) AS v", "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) t(a, b)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(name) for name in _ENTRIES}


def oracle_sql() -> dict[str, str]:
    return {name: oracle for name, (_, oracle, _) in _ENTRIES.items()}
