"""Queries over the driver's tables, with the SQL that checks each.

The tables stand in for a code base's facts: parts are files, brands are groups (directories, crates), orders
are commits, line items are touches of files, customers and suppliers are authors, documents are sources.
Thresholds that the reference data suits are parameters of the operators; the values here suit these tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide, graphs, history, provenance, registry, structure, text
from ..sources.shared import Stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows of a fact table that one task of a shuffle takes at most, on the average: a fixed number of partitions would give a task more memory to fill the larger the table is.
TASK_ROWS = 1 << 19


def parts(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions for a shuffle of a table's rows: those of the session, or more if the table needs them. The count of a Parquet table reads its footers."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def dealt(df: DataFrame, n: int, key: str) -> DataFrame:
    """df in n partitions by a key, for a join or an aggregation by it; as it is where the session's partitions do."""
    return df.repartition(n, key) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# ---- facts -------------------------------------------------------------------


def touches(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").alias("author"))
    li = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))
    p = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("grp"))
    n = parts(li)
    return dealt(dealt(li, n, "commit_id").distinct().join(o, "commit_id"), n, "file").join(p, "file")


TOUCHES = """touches AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file, CAST(o_orderdate AS DATE) AS day, o_custkey AS author, p_brand AS grp
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
 anchor AS (SELECT max(day) AS a FROM touches), aged AS (SELECT t.*, date_diff('day', day, a) AS age FROM touches t, anchor)"""


def blame(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select(F.col("l_partkey").alias("file"), F.col("l_suppkey").alias("author"), F.col("l_quantity").cast("long").alias("lines"))
    return dealt(li, parts(li), "file")


BLAME = """blame AS (SELECT l_partkey AS file, l_suppkey AS author, sum(CAST(l_quantity AS BIGINT)) AS lines FROM lineitem GROUP BY 1, 2),
 owned AS (SELECT *, sum(lines) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY lines DESC, author) AS n,
 sum(lines) OVER (PARTITION BY file ORDER BY lines DESC, author ROWS UNBOUNDED PRECEDING) AS held FROM blame)"""


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("grp"), F.length("text").cast("long").alias("size"))


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier nation's two customer nations of most line items, as edges."""
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("src"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("dst"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    li = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    n = dealt(li, parts(li), "l_orderkey").join(o.join(c, "o_custkey"), "l_orderkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    from pyspark.sql import Window

    return n.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where("r <= 2").select("src", "dst", (2 * F.col("f") < F.col("n")).alias("production"))


TRADE = """pairs AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2),
 trade AS (SELECT src, dst, 2 * f < n AS production FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM pairs) WHERE r <= 2),
 nodes AS (SELECT DISTINCT src AS node FROM trade UNION SELECT dst FROM trade)"""
#: Shortest paths from every node: breadth first by depth, the least path on ties.
PATHS = TRADE + """, walk(start, node, path, depth) AS (SELECT src, dst, [src, dst], 1 FROM trade
 UNION ALL SELECT start, dst, list_append(path, dst), depth + 1 FROM walk JOIN trade ON src = node WHERE depth < 12 AND (start = dst OR NOT list_contains(path, dst)) AND node <> start),
 best AS (SELECT start, node, min(depth) AS depth, arg_min(path, (depth, path)) AS path FROM walk GROUP BY 1, 2)"""


def layers(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").cast("long").alias("layer"))


# ---- history -----------------------------------------------------------------


@query(f"""WITH {TOUCHES}, w AS (SELECT file, count(*) AS commits, sum(pow(0.5, age / 90.0)) AS weight FROM aged WHERE age <= 365 GROUP BY 1)
SELECT file, CAST(p_size AS BIGINT) AS complexity, commits, round(p_size * weight, 4) AS score FROM w JOIN part ON p_partkey = file ORDER BY score DESC, file LIMIT 15""")
def hotspot_top15(spark, d, touched=None):
    complexity = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").cast("long").alias("complexity"))
    return history.hotspots(touches(spark, d) if touched is None else touched, complexity, 365)


@query(f"WITH {TOUCHES} SELECT file, count(*) AS commits FROM aged WHERE age <= 365 GROUP BY 1")
def churn_window_counts(spark, d):
    return history.churn(touches(spark, d), 365)


@query(f"WITH {TOUCHES} SELECT file, count(*) AS commits, round(sum(pow(0.5, age / 90.0)), 6) AS weight FROM aged WHERE age <= 730 GROUP BY 1")
def churn_recency_weight(spark, d):
    return history.recency_churn(touches(spark, d), 730).withColumn("weight", F.round("weight", 6))


@query(f"WITH {TOUCHES} SELECT file, count(*) AS commits FROM aged WHERE age <= 300 GROUP BY 1 HAVING count(*) >= 5")
def churn_hotspot_window(spark, d, touched=None):
    return history.churn_hotspots(touches(spark, d) if touched is None else touched, 300, 5)


@query(f"""WITH {TOUCHES}, seen AS (SELECT file, count(*) AS c FROM aged WHERE age <= 150 GROUP BY 1),
f AS (SELECT p_partkey AS file, p_brand AS grp, CASE WHEN c > 0 THEN 1 ELSE 0 END AS active FROM part LEFT JOIN seen ON file = p_partkey)
SELECT file, grp, CAST(s AS BIGINT) AS active_siblings FROM (SELECT *, sum(active) OVER (PARTITION BY grp) AS s FROM f) WHERE active = 0 AND s >= 2""")
def legacy_freeze_siblings(spark, d, touched=None):
    return history.legacy_freeze(t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("grp")), touches(spark, d) if touched is None else touched, 150)


@query(f"WITH {TOUCHES} SELECT DISTINCT author FROM aged WHERE age <= 60")
def active_authors(spark, d):
    return history.active_authors(touches(spark, d), 60)


GINI = """ranked AS (SELECT source AS grp, doc_id AS file, length(text) AS size, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS i,
 row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents),
 g AS (SELECT grp, count(*) AS n, round(CASE WHEN count(*) <= 1 OR sum(size) = 0 THEN 0.0 ELSE 2.0 * sum(i * size) / (count(*) * sum(size)) - (count(*) + 1.0) / count(*) END, 6) AS gini FROM ranked GROUP BY 1)"""


@query(f"WITH {GINI} SELECT grp, n, gini FROM g")
def size_gini_by_group(spark, d):
    return history.gini(doc_files(spark, d))


@query(f"WITH {GINI} SELECT file, grp, CAST(size AS BIGINT) AS size, gini FROM ranked JOIN g USING (grp) WHERE gini > 0.4 AND r <= n - (n * 9) // 10")
def size_distribution_outliers(spark, d):
    return history.size_outliers(doc_files(spark, d), 0.4)


@query(f"WITH {BLAME} SELECT file, author, CAST(lines AS BIGINT) AS lines, CAST(total AS BIGINT) AS total, CAST(lines AS DOUBLE) / CAST(total AS DOUBLE) AS share FROM owned")
def ownership_shares(spark, d):
    return history.ownership(blame(spark, d))


@query(f"WITH {BLAME} SELECT file, count(*) AS authors, min(n) FILTER (held > 0.5 * total) AS bus_factor, round(max(lines / total), 6) AS top_share FROM owned GROUP BY 1")
def bus_factor(spark, d):
    return history.bus_factor(blame(spark, d))


@query("""WITH b AS (SELECT o_custkey AS file, o_orderkey % 100 AS author, sum(CAST(floor(o_totalprice) AS BIGINT)) AS lines FROM orders GROUP BY 1, 2),
o AS (SELECT *, sum(lines) OVER (PARTITION BY file) AS total, row_number() OVER (PARTITION BY file ORDER BY lines DESC, author) AS n FROM b)
SELECT file, o.author, CASE WHEN s_suppkey IS NULL THEN 'Fail' ELSE 'Warn' END AS severity FROM o LEFT JOIN supplier ON s_suppkey = o.author AND s_acctbal > 0 WHERE n = 1 AND lines > 0.5 * total AND (SELECT count(DISTINCT author) FROM b) >= 2""")
def low_bus_factor_severity(spark, d):
    lines = F.expr("cast(floor(o_totalprice) as bigint)")
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("file"), (F.col("o_orderkey") % 100).alias("author"), lines.alias("lines"))
    return history.low_bus_factor(rows, t(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("author")))


@query(f"""WITH {BLAME} SELECT file, count(*) AS authors, CAST(max(total) AS BIGINT) AS lines, round(max(lines / total), 6) AS top_share,
array_to_string(list_sort(list(author) FILTER (n <= 5)), ',') AS top_authors FROM owned GROUP BY file HAVING count(*) >= 4 AND max(lines / total) < 0.35 AND max(total) >= 50""")
def ownership_fragmentation(spark, d):
    return history.fragmentation(blame(spark, d))


@query("SELECT p_partkey AS file, p_size AS lines_of_code, p_partkey % 7 AS cyclomatic FROM part WHERE p_size >= 40 AND p_partkey % 7 <= 3")
def complexity_inflation(spark, d):
    functions = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_size").alias("lines_of_code"), (F.col("p_partkey") % 7).alias("cyclomatic"))
    return structure.complexity_inflation(functions)


@query(f"""WITH {TOUCHES}, own AS (SELECT DISTINCT commit_id, grp FROM touches), tot AS (SELECT grp, count(*) AS n FROM own GROUP BY 1),
layer AS (SELECT DISTINCT p_brand AS grp, CAST(right(p_brand, 1) AS INTEGER) % 4 AS layer FROM part),
p AS (SELECT x.grp AS a, y.grp AS b, count(*) AS together FROM own x JOIN own y ON x.commit_id = y.commit_id AND x.grp < y.grp GROUP BY 1, 2)
SELECT a, b, together, round(together / least(ta.n, tb.n), 6) AS ratio FROM p JOIN tot ta ON ta.grp = a JOIN tot tb ON tb.grp = b JOIN layer la ON la.grp = a JOIN layer lb ON lb.grp = b
WHERE together >= 5 AND la.layer <> lb.layer AND together / least(ta.n, tb.n) >= 0.12""")
def change_coupling(spark, d):
    layer = t(spark, d, "part").select(F.col("p_brand").alias("grp"), (F.right("p_brand", F.lit(1)).cast("int") % 4).alias("layer")).distinct()
    groups = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("grp"))
    items = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))
    commits = t(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"))
    # a commit's groups are a set, so its touches need not be made distinct first
    return history.change_coupling(items.join(groups, "file").join(commits, "commit_id").select("commit_id", "grp"), layer, 5, 0.12)


@query(f"""WITH {TOUCHES}, s AS (SELECT commit_id, count(DISTINCT file) AS files FROM touches GROUP BY 1), l AS (SELECT count(*) AS n, avg(files) + 2 * stddev_pop(files) AS th FROM s)
SELECT commit_id, files, round(th, 6) AS threshold FROM s, l WHERE n >= 10 AND files > th""")
def commit_size_outlier(spark, d):
    return history.commit_size_outliers(touches(spark, d))


@query("""WITH g AS (SELECT user_id AS author, epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts)), event_id) AS gap FROM events)
SELECT author, count(*) AS n, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM g GROUP BY 1 HAVING count(*) >= 5 AND avg(gap) > 0 AND round(stddev_pop(gap) / avg(gap), 6) < 0.9""")
def regular_cadence_cv(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("author"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"), F.col("event_id").alias("id"))
    return history.regular_cadence(e, 5, 0.9)


# ---- graph -------------------------------------------------------------------


@query(f"""WITH {TRADE} SELECT src, dst, CAST(a.n_regionkey AS BIGINT) AS src_layer, CAST(b.n_regionkey AS BIGINT) AS dst_layer FROM trade
JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey < b.n_regionkey""")
def layer_rules_direct(spark, d):
    return graphs.forbidden_edges(trade(spark, d), layers(spark, d))


@query(f"""WITH RECURSIVE {PATHS} SELECT start, node, CAST(depth AS INTEGER) AS depth, array_to_string(path, '>') AS path FROM best JOIN nation a ON a.n_nationkey = start JOIN nation b ON b.n_nationkey = node WHERE a.n_regionkey < b.n_regionkey""")
def layer_rules_transitive(spark, d):
    return graphs.forbidden_paths(trade(spark, d), layers(spark, d))


@query(f"""WITH {TRADE}, r AS (SELECT n_nationkey AS src, o.k AS required FROM nation, (VALUES (1), (2), (3), (4), (5)) o(k))
SELECT DISTINCT CAST(src AS BIGINT) AS src FROM r WHERE src NOT IN (SELECT t.src FROM trade t JOIN r ON r.src = t.src AND r.required = t.dst)""")
def required_any_of_missing(spark, d):
    rules = layers(spark, d).select(F.col("node").alias("src"), F.explode(F.array(*[F.lit(i).cast("long") for i in range(1, 6)])).alias("required"))
    return graphs.missing_required(trade(spark, d), rules)


@query(f"""WITH RECURSIVE {TRADE}, walk(root, node, path) AS (SELECT src, dst, [src] FROM trade WHERE dst >= src
 UNION ALL SELECT root, dst, list_append(path, node) FROM walk JOIN trade ON src = node WHERE node > root AND dst >= root AND NOT list_contains(path, node) AND len(path) < 4)
SELECT DISTINCT array_to_string(path, ',') AS cycle, CAST(len(path) AS INTEGER) AS length FROM walk WHERE node = root""")
def graph_cycles_bounded(spark, d):
    return graphs.cycles(trade(spark, d), 4)


@query(f"""WITH RECURSIVE {TRADE}, reach(start, node) AS (SELECT src, dst FROM trade UNION SELECT start, dst FROM reach JOIN trade ON src = node)
SELECT n.node, count(r.node) AS reachable FROM nodes n LEFT JOIN reach r ON r.start = n.node GROUP BY 1""")
def transitive_closure_size(spark, d):
    return graphs.closure_size(trade(spark, d))


@query(f"""WITH RECURSIVE {TRADE}, reach(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM reach JOIN trade ON src = node WHERE production) SELECT node FROM reach""")
def production_reachable(spark, d):
    return graphs.reachable(trade(spark, d).where("production"), spark.range(1).select(F.col("id").alias("node")))


@query(f"""WITH RECURSIVE {TRADE}, reach(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM reach JOIN trade ON src = node WHERE production)
SELECT item_id AS id, item_id % 40 AS name, CASE WHEN n.node IS NULL THEN 'unknown' WHEN r.node IS NOT NULL THEN 'production' ELSE 'dev_only' END AS state,
CASE WHEN n.node IS NOT NULL AND r.node IS NOT NULL THEN 'Fail' ELSE 'Warn' END AS severity FROM benchmark LEFT JOIN nodes n ON n.node = item_id % 40 LEFT JOIN reach r ON r.node = item_id % 40""")
def advisory_reachability(spark, d):
    edges = trade(spark, d)
    advisories = t(spark, d, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 40).alias("name"))
    edges = Stored(edges).frame
    resolved = edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct()
    production = graphs.reachable(edges.where("production"), spark.range(1).select(F.col("id").alias("node"))).select(F.col("node").alias("name"))
    return registry.advisory_state(advisories, resolved, production)


@query(f"""WITH RECURSIVE {TRADE}, reach(node, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION SELECT dst, depth + 1 FROM reach JOIN trade ON src = node WHERE depth < 12)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE depth > 0 GROUP BY 1""")
def why_live_depth(spark, d):
    return graphs.shortest_paths(trade(spark, d), spark.range(3, 4).select(F.col("id").alias("node"))).select("node", "depth")


@query(f"WITH RECURSIVE {PATHS} SELECT node, array_to_string(path, '>') AS path FROM best WHERE start = 3")
def why_live_path(spark, d):
    return graphs.shortest_paths(trade(spark, d), spark.range(3, 4).select(F.col("id").alias("node"))).select("node", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query(f"""WITH {TRADE}, l AS (SELECT DISTINCT '  "' || src || '" -> "' || dst || '";' AS l FROM trade) SELECT 'digraph {{' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) || '}}' || chr(10) AS dot FROM l""")
def dot_export(spark, d):
    return graphs.dot(trade(spark, d))


@query(f"""WITH {TRADE}, l AS (SELECT DISTINCT '  ' || src || ' --> ' || dst AS l FROM trade) SELECT 'graph TD' || chr(10) || string_agg(l, chr(10) ORDER BY l) || chr(10) AS mermaid FROM l""")
def mermaid_export(spark, d):
    return graphs.mermaid(trade(spark, d))


# ---- registry ----------------------------------------------------------------


@query("""SELECT p_name AS name, count(DISTINCT p_brand) AS n, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS found FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2""")
def duplicate_versions(spark, d):
    return registry.several(t(spark, d, "part").select(F.col("p_name").alias("name"), "p_brand"), "name", "p_brand").withColumn("n", F.col("n").cast("long"))


@query("""SELECT p_brand AS name, count(DISTINCT p_type) AS n, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS found FROM part GROUP BY 1 HAVING count(DISTINCT p_type) >= 2""")
def requirement_drift(spark, d):
    return registry.several(t(spark, d, "part").select(F.col("p_brand").alias("name"), "p_type"), "name", "p_type").withColumn("n", F.col("n").cast("long"))


@query("""SELECT user_id AS name FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)""")
def unused_in_every_target(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_type").alias("target"))
    return registry.unused_everywhere(e, e)


@query("SELECT o_custkey AS name, count(DISTINCT o_orderpriority) AS owners FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) < 2")
def single_maintainer(spark, d):
    return registry.few_owners(t(spark, d, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("login")))


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def phantom_antijoin(spark, d):
    return registry.phantom(t(spark, d, "part").select(F.col("p_partkey").alias("name")), t(spark, d, "customer").select(F.col("c_custkey").alias("name")))


@query("""SELECT DISTINCT l_partkey AS name, l_suppkey AS vers FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0""")
def yanked_versions(spark, d):
    versions = t(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("vers")).distinct()
    marked = versions.join(t(spark, d, "supplier").select(F.col("s_suppkey").alias("vers"), (F.col("s_acctbal") < 0).alias("yanked")), "vers")
    return registry.yanked(versions, marked)


@query("""WITH m AS (SELECT c_custkey AS name, min(CAST(o_orderdate AS DATE)) AS created, count(*) AS downloads, CASE WHEN c_acctbal < 5000 THEN ' ' ELSE c_mktsegment END AS repository FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
SELECT name FROM m WHERE date_diff('day', created, DATE '1996-01-01') < 200 AND downloads < 12 AND trim(coalesce(repository, '')) = ''""")
def fresh_low_reputation(spark, d):
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.when(F.col("c_acctbal") < 5000, " ").otherwise(F.col("c_mktsegment")).alias("repository"))
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.min(F.to_date("o_orderdate")).alias("created"), F.count("*").alias("downloads"))
    return registry.fresh_low_reputation(c.join(o, "name"), F.lit("1996-01-01").cast("date"), 200, 12)


@query("""WITH v AS (SELECT DISTINCT p_name AS name, p_size AS major, CAST(floor(p_retailprice) AS INTEGER) AS minor, CAST(p_partkey AS INTEGER) AS patch FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY major DESC, minor DESC, patch DESC) AS n FROM v)
SELECT name, string_agg(concat_ws('.', major, minor, patch), ',' ORDER BY n) AS nearest FROM r WHERE n <= 3 GROUP BY 1""")
def nearest_versions_top3(spark, d):
    v = t(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("major"), F.expr("cast(floor(p_retailprice) as int)").alias("minor"), F.col("p_partkey").cast("int").alias("patch"))
    return registry.nearest_versions(v)


@query("SELECT l_partkey AS target, count(DISTINCT l_orderkey) AS fan_in FROM lineitem WHERE l_orderkey <> l_partkey GROUP BY 1")
def fan_in_distinct_files(spark, d):
    references = t(spark, d, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_partkey").alias("target_file"), F.col("l_orderkey").alias("file"))
    return structure.fan_in(references)


@query("""WITH i AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN 'Debug' WHEN o_orderkey = 7 THEN 'FromStr' ELSE 't' || o_custkey END AS trait, o_orderpriority AS type FROM orders)
SELECT trait, min(type) AS type FROM i WHERE trait NOT IN ('Debug', 'FromStr') GROUP BY 1 HAVING count(*) = 1""")
def single_member_groups(spark, d):
    trait = F.when(F.col("o_custkey") % 50 == 0, "Debug").when(F.col("o_orderkey") == 7, "FromStr").otherwise(F.concat(F.lit("t"), F.col("o_custkey")))
    return structure.single_implementors(t(spark, d, "orders").select(trait.alias("trait"), F.col("o_orderpriority").alias("type")))


@query("""WITH s AS (SELECT l_orderkey AS grp, l_suppkey AS type, list(DISTINCT l_partkey) AS m FROM lineitem GROUP BY 1, 2), w AS (SELECT l_orderkey AS grp FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 6),
p AS (SELECT x.grp, x.type AS a, y.type AS b FROM s x JOIN s y ON x.grp = y.grp AND x.type < y.type WHERE x.grp IN (SELECT grp FROM w) AND NOT list_has_any(x.m, y.m))
SELECT grp, a, b FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY a, b) AS n FROM p) WHERE n = 1""")
def disjoint_implementors(spark, d):
    return registry.disjoint_implementors(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_suppkey").alias("type"), F.col("l_partkey").alias("method")), 6)


# ---- decisions ---------------------------------------------------------------

_FINDING = """SELECT {id} AS id, 'r' || (o_custkey % 7) AS rule, CASE o_orderstatus WHEN 'F' THEN 'Fail' WHEN 'O' THEN 'Warn' ELSE 'Info' END AS severity,
 CASE o_custkey % 4 WHEN 0 THEN 'heuristic' WHEN 1 THEN 'derived_fact' WHEN 2 THEN 'bounded_semantic' ELSE 'external_measurement' END AS evidence_class, o_orderpriority AS file, o_custkey % 25 AS grp FROM orders"""
FINDINGS = f"cur AS ({_FINDING.format(id='o_orderkey')} WHERE o_orderdate >= TIMESTAMP '1996-01-01'), base AS ({_FINDING.format(id='o_orderkey')} WHERE o_orderdate < TIMESTAMP '2000-01-01')"
DELTA = FINDINGS + """, j AS (SELECT coalesce(c.id, b.id) AS id, coalesce(c.rule, b.rule) AS rule, coalesce(c.severity, b.severity) AS severity, coalesce(c.evidence_class, b.evidence_class) AS evidence_class, c.id AS cid, b.id AS bid,
 c.rule NOT IN ('r1', 'r2') AS same, c.rule <> 'r2' AS had, c.file IN ('1-URGENT', '2-HIGH') AS touched FROM cur c FULL JOIN base b ON b.id = c.id),
 delta AS (SELECT id, rule, severity, evidence_class, CASE WHEN cid IS NULL THEN 'resolved' WHEN bid IS NOT NULL AND same THEN 'unchanged' WHEN NOT same AND had AND NOT touched THEN 'rule_introduced' ELSE 'code_introduced' END AS state FROM j)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders")
    cls = F.element_at(F.array(*map(F.lit, ("heuristic", "derived_fact", "bounded_semantic", "external_measurement"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    sev = F.when(F.col("o_orderstatus") == "F", "Fail").when(F.col("o_orderstatus") == "O", "Warn").otherwise("Info")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("r"), F.col("o_custkey") % 7).alias("rule"), sev.alias("severity"), cls.alias("evidence_class"), F.col("o_orderpriority").alias("file"), (F.col("o_custkey") % 25).alias("grp"), "o_orderdate")


def changes(spark: SparkSession, d: str) -> DataFrame:
    all_ = findings(spark, d)
    current, baseline = all_.where("o_orderdate >= timestamp_ntz '1996-01-01'"), all_.where("o_orderdate < timestamp_ntz '2000-01-01'")
    revisions = spark.createDataFrame([(f"r{i}", None if i == 2 else 1, 2 if i in (1, 2) else 1) for i in range(7)], "rule string, before int, after int")
    touched = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "file string")
    return decide.delta(current, baseline, touched, revisions)


@query(f"WITH {DELTA} SELECT * FROM delta")
def baseline_delta(spark, d):
    return changes(spark, d)


@query(f"""WITH {DELTA}, n AS (SELECT CASE severity WHEN 'Fail' THEN 3 WHEN 'Warn' THEN 2 ELSE 1 END AS r FROM delta WHERE state = 'code_introduced' AND evidence_class <> 'heuristic')
SELECT count(*) AS gating_new, CASE WHEN coalesce(max(r), 1) > 1 THEN 'fail' ELSE 'pass' END AS verdict, CASE coalesce(max(r), 1) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'pass' END AS tri_verdict FROM n""")
def verdict_two_and_three_state(spark, d):
    return decide.verdicts(changes(spark, d))


@query("""SELECT o_custkey AS grp, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) AS sample,
CASE WHEN count(*) < 10 THEN 'not_evaluated_small_sample' WHEN count(*) FILTER (o_orderstatus = 'F') / count(*) > 0.5 THEN 'fail' ELSE 'pass' END AS gate FROM orders GROUP BY 1""")
def ratio_gate_small_sample(spark, d):
    rows = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("hits"), F.count("*").alias("sample"))
    return decide.ratio_gate(rows, "hits", "sample", 10, 0.5)


def _score(where: str) -> str:
    return f"""(WITH f AS (SELECT * FROM ({_FINDING.format(id='o_orderkey')} WHERE {where}) WHERE evidence_class <> 'heuristic'),
 s AS (SELECT grp, count(*) FILTER (severity = 'Fail') AS fails, count(*) FILTER (severity = 'Warn') AS warns, sum(CASE severity WHEN 'Fail' THEN 10 WHEN 'Warn' THEN 3 ELSE 0 END * CASE WHEN grp < 5 THEN 0.5 ELSE 1.0 END) AS ded FROM f GROUP BY 1),
 loc AS (SELECT c_custkey % 25 AS grp, CAST(sum(c_acctbal) AS BIGINT) AS loc FROM customer GROUP BY 1)
 SELECT loc.grp, coalesce(fails, 0) AS fails, coalesce(warns, 0) AS warns, round(CASE WHEN loc > 0 THEN greatest(0.0, least(100.0, 100 - coalesce(ded, 0) * 1000.0 / loc)) END, 4) AS score FROM loc LEFT JOIN s ON s.grp = loc.grp)"""


_GRADE = "CASE WHEN score IS NULL THEN 'unavailable' WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade"


def scores(spark: SparkSession, d: str, where: str) -> DataFrame:
    loc = t(spark, d, "customer").groupBy((F.col("c_custkey") % 25).alias("grp")).agg(F.expr("cast(round(sum(c_acctbal)) as bigint)").alias("loc"))
    profiles = spark.createDataFrame([(i, 0.5) for i in range(5)], "grp bigint, multiplier double")
    return decide.health_score(findings(spark, d).where(where), loc, profiles)


@query(f"SELECT *, {_GRADE} FROM {_score('true')}")
def health_score_grade(spark, d):
    return scores(spark, d, "true")


@query(f"""SELECT n.grp, CASE n.grp % 5 WHEN 0 THEN 'missing_score_context' WHEN 1 THEN 'formula_version_changed' WHEN 2 THEN 'profiles_changed' WHEN 3 THEN 'baseline_loc_unavailable' ELSE 'comparable' END AS state,
CASE WHEN n.grp % 5 = 4 THEN round(n.score - b.score, 4) END AS change FROM {_score("o_orderdate >= TIMESTAMP '1998-01-01'")} n JOIN {_score("o_orderdate < TIMESTAMP '1998-01-01'")} b ON b.grp = n.grp""")
def score_trend_comparable(spark, d):
    now, old = scores(spark, d, "o_orderdate >= timestamp_ntz '1998-01-01'"), scores(spark, d, "o_orderdate < timestamp_ntz '1998-01-01'")
    kind = F.col("grp") % 5
    context = {
        "formula_version": F.when(kind == 1, 1).when(kind > 1, 2),
        "same_profiles": kind != 2,
        "loc": F.when(kind == 3, 0).otherwise(1000),
    }
    return decide.trend(now, old.withColumns(context))


@query("""SELECT event_id, user_id AS file, line FROM (SELECT event_id, user_id, event_id % 1000 AS line FROM events) e
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = user_id AND line BETWEEN (c_custkey * 7) % 500 AND (c_custkey * 7) % 500 + 300)""")
def interval_suppression(spark, d):
    rows = t(spark, d, "events").select("event_id", F.col("user_id").alias("file"), (F.col("event_id") % 1000).alias("line"))
    ranges = t(spark, d, "customer").select(F.col("c_custkey").alias("file"), (F.col("c_custkey") * 7 % 500).alias("from_line"), (F.col("c_custkey") * 7 % 500 + 300).alias("to_line"))
    return decide.outside_ranges(rows, ranges)


@query("""WITH p AS (SELECT event_id, user_id % 50 AS file, event_id % 1000 AS line FROM events), s AS (SELECT p_partkey % 50 AS file, p_partkey % 900 AS a, p_partkey % 900 + p_size AS b, p_partkey AS item FROM part),
h AS (SELECT p.file, p.line, item, row_number() OVER (PARTITION BY p.file, p.line ORDER BY b - a, item) AS n FROM (SELECT DISTINCT file, line FROM p) p JOIN s ON s.file = p.file AND line BETWEEN a AND b)
SELECT p.event_id, p.file, p.line, h.item FROM p LEFT JOIN h ON h.file = p.file AND h.line = p.line AND n = 1""")
def innermost_span(spark, d):
    points = t(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("file"), (F.col("event_id") % 1000).alias("line"))
    spans = t(spark, d, "part").select((F.col("p_partkey") % 50).alias("file"), (F.col("p_partkey") % 900).alias("from_line"), (F.col("p_partkey") % 900 + F.col("p_size")).alias("to_line"), F.col("p_partkey").alias("item"))
    return decide.innermost(points, spans)


@query("""WITH f AS (SELECT o_orderkey AS id FROM orders), e AS (SELECT DISTINCT a.o_orderkey AS c, b.o_orderkey AS e FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT id, u.x AS caused_by, w.x AS causes, u.x IS NULL AS is_root FROM f LEFT JOIN (SELECT e AS id, array_to_string(list_sort(list(DISTINCT c)), ',') AS x FROM e GROUP BY 1) u USING (id) LEFT JOIN (SELECT c AS id, array_to_string(list_sort(list(DISTINCT e)), ',') AS x FROM e GROUP BY 1) w USING (id)""")
def finding_roots_and_cascades(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    edges = o.withColumnRenamed("id", "cause").join(o.withColumnRenamed("id", "effect"), "o_custkey").where("cause < effect").select("cause", "effect")
    return decide.roots_and_cascades(o.select("id"), edges)


@query("""WITH r(ord, seg, bal, label) AS (VALUES (1, 'BUILDING', 5000, 'big-builder'), (2, 'BUILDING', -9999, 'builder'), (3, 'MACHINERY', 0, 'machines'))
SELECT c_custkey, c_mktsegment, c_acctbal, (SELECT arg_min(label, ord) FROM r WHERE seg = c_mktsegment AND c_acctbal >= bal) AS label FROM customer""")
def first_match_label(spark, d):
    rules = spark.createDataFrame([(1, "BUILDING", 5000.0, "big-builder"), (2, "BUILDING", -9999.0, "builder"), (3, "MACHINERY", 0.0, "machines")], "ord int, seg string, bal double, label string")
    rows = t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return decide.first_match(rows, rules, (F.col("seg") == F.col("c_mktsegment")) & (F.col("c_acctbal") >= F.col("bal")), "c_custkey")


@query("""WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS hits FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS file, count(line) AS lines, count(*) FILTER (hits > 0) AS covered, CAST(100 AS DOUBLE) * count(*) FILTER (hits > 0) / nullif(count(line), 0) AS percent FROM orders LEFT JOIN l ON file = o_orderkey GROUP BY 1""")
def coverage_pct_nullable(spark, d):
    hits = F.max(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("hits")
    lines = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(hits)
    return structure.line_coverage(t(spark, d, "orders").select(F.col("o_orderkey").alias("file")), lines)


@query("SELECT o_orderkey AS file FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def no_coverage_antijoin(spark, d):
    lines = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"))
    return structure.uncovered_files(t(spark, d, "orders").select(F.col("o_orderkey").alias("file")), lines)


# ---- text --------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0), n AS (SELECT doc_id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2)
SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1""")
def shannon_entropy(spark, d):
    return text.entropy(t(spark, d, "documents"), "doc_id", "text")


@query("""WITH p(phrase, tier) AS (VALUES ('the and', 1), ('of the', 1), ('la de', 2), ('und', 2)) SELECT doc_id, phrase, tier FROM documents, p WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || phrase || '($|[^\\p{L}\\p{N}])')""")
def conversational_phrases(spark, d):
    phrases = spark.createDataFrame([("the and", 1), ("of the", 1), ("la de", 2), ("und", 2)], "phrase string, tier int")
    return text.phrase_hits(t(spark, d, "documents"), "text", phrases).select("doc_id", "phrase", "tier")


STEPS = """l AS (SELECT doc_id AS file, unnest(generate_series(1, len(string_split(text, chr(10)))))::INTEGER AS line, unnest(string_split(text, chr(10))) AS text FROM documents),
 c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS k FROM l WHERE length(text) % 3 <> 0),
 s AS (SELECT file, line, ((k - 1) % 7 + 1)::INTEGER AS number, line // 20 AS item FROM c WHERE length(text) % 5 <> 0)"""


@query(f"""WITH {STEPS}, p AS (SELECT *, lag(number) OVER w AS n0, lag(item) OVER w AS i0, lag(line) OVER w AS l0 FROM s WINDOW w AS (PARTITION BY file ORDER BY line)),
g AS (SELECT p.file, p.line, count(l.line) FILTER (trim(l.text) <> '') AS between_ FROM p LEFT JOIN l ON l.file = p.file AND l.line > l0 AND l.line < p.line GROUP BY 1, 2),
r AS (SELECT p.*, sum(CASE WHEN number = n0 + 1 AND item = i0 AND between_ <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY p.file ORDER BY p.line) AS run FROM p JOIN g USING (file, line))
SELECT file, any_value(item)::INTEGER AS item, min(line) AS first_line, count(*)::INTEGER AS length, array_to_string(list(line ORDER BY line), ',') AS lines FROM r GROUP BY file, run HAVING count(*) >= 3""")
def step_chain_islands(spark, d):
    """Two of three lines of a document are comments, numbered 1 to 7 again and again; four of five of them are no documentation. Twenty lines are an item."""
    lines = t(spark, d, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    from pyspark.sql import Window

    comments = lines.where(F.length("text") % 3 != 0).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("line")))
    steps = comments.where(F.length("text") % 5 != 0).select("file", "line", ((F.col("k") - 1) % 7 + 1).alias("number"), F.floor(F.col("line") / 20).cast("int").alias("item"))
    return text.step_chains(steps, lines).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


def words(spark: SparkSession, d: str, name: str) -> DataFrame:
    return t(spark, d, name).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name")).distinct()


WORDS = "w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS name FROM {} )"


@query(f"""WITH {WORDS.format('documents')}, p AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS name FROM benchmark),
a AS (SELECT name, unnest(list_append(list_transform(generate_series(1, length(name)), lambda i: left(name, i - 1) || substr(name, i + 1)), name)) AS v FROM w WHERE length(name) >= 6),
b AS (SELECT name, unnest(list_append(list_transform(generate_series(1, length(name)), lambda i: left(name, i - 1) || substr(name, i + 1)), name)) AS v FROM p WHERE length(name) >= 5)
SELECT a.name, min(b.name) AS nearest FROM a JOIN b USING (v) WHERE levenshtein(a.name, b.name) = 1 GROUP BY 1""")
def name_collision_levenshtein(spark, d):
    """Names from the reference's six letters on. In the SQL, too, only names meet that share a text with one letter left out."""
    return text.near_names(words(spark, d, "documents"), words(spark, d, "benchmark"))


@query("""WITH a AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '[A-Za-z_]*(?:token|secret|password|key)[A-Za-z_]* = "[^"]+"')) AS m FROM documents) SELECT id, m, regexp_extract(m, '^([A-Za-z_]+)', 1) AS name FROM a""")
def secret_assignments(spark, d):
    m = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.expr("""regexp_extract_all(text, '[A-Za-z_]*(?:token|secret|password|key)[A-Za-z_]* = "[^"]+"', 0)""")).alias("m"))
    return m.withColumn("name", F.regexp_extract("m", "^([A-Za-z_]+)", 1))


@query("""WITH l AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_]+ = "[^"]+"') AS l FROM documents), m AS (SELECT doc_id || ':' || unnest(range(len(l))) AS id, unnest(l) AS m FROM l),
v AS (SELECT id, regexp_extract(m, '^([A-Za-z_]+)', 1) AS name, regexp_extract(m, '"([^"]+)"', 1) AS value FROM m), c AS (SELECT id, unnest(string_split(value, '')) AS c FROM v), n AS (SELECT id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY 1, 2),
e AS (SELECT id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM n GROUP BY 1),
k AS (SELECT id, name, entropy, CASE WHEN regexp_full_match(value, 'AKIA[A-Z0-9]{16}') THEN 'aws_access_key_id' WHEN regexp_full_match(value, 'gh[pousr]_[A-Za-z0-9]{36}') THEN 'github_token'
 WHEN regexp_matches(value, '^xox[bpars]-') AND length(value) >= 20 THEN 'slack_token' WHEN regexp_full_match(value, 'AIza[A-Za-z0-9_-]{35}') THEN 'google_api_key'
 WHEN contains(value, '-----BEGIN') AND contains(value, 'PRIVATE KEY-----') THEN 'pem_private_key'
 WHEN regexp_matches('_' || regexp_replace(replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '-', '_'), '_+', '_', 'g') || '_', '_(secret|password|passwd|token|apikey|api_key|access_key|private_key|client_secret|auth_token|credential)_')
 AND strlen(value) >= 16 AND entropy >= 3.5 THEN 'entropy' END AS lane FROM v JOIN e USING (id)) SELECT id, name, lane, entropy FROM k WHERE lane IS NOT NULL""")
def secret_patterns_entropy(spark, d):
    a = t(spark, d, "documents").select("doc_id", F.posexplode(F.expr("""regexp_extract_all(text, '([A-Za-z_]+) = "([^"]+)"', 0)""")).alias("n", "m"))
    rows = a.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("n").cast("string")).alias("id"), F.regexp_extract("m", "^([A-Za-z_]+)", 1).alias("name"), F.regexp_extract("m", '"([^"]+)"', 1).alias("value"))
    return text.secrets(rows)


@query("""WITH l AS (SELECT doc_id AS doc, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS s FROM documents), n AS (SELECT doc, line, list_distinct(list_filter(regexp_split_to_array(lower(s), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS a FROM l WHERE trim(s) <> ''),
p AS (SELECT doc, line, a, lead(a) OVER (PARTITION BY doc ORDER BY line) AS b FROM n), q AS (SELECT doc, line, a, b, len(list_intersect(a, b)) AS i FROM p WHERE b IS NOT NULL AND len(a) >= 4 AND len(b) >= 3)
SELECT doc, CAST(line AS INTEGER) AS line, round(i / (len(a) + len(b) - i), 6) AS jaccard FROM q WHERE round(i / (len(a) + len(b) - i), 6) >= 0.2""")
def restating_jaccard(spark, d):
    lines = t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line", "text")).where(F.trim("text") != "").withColumn("line", F.col("line") + 1)
    return text.restating_pairs(lines, 0.2)


@query("""WITH f AS (SELECT conv_id * 1000 + turn AS id, list_filter(string_split(text, ' '), lambda x: x <> '') AS k FROM conversations),
w AS (SELECT id, p - 1 AS pos, array_to_string(k[p : p + 4], chr(1)) AS h FROM (SELECT id, k, unnest(generate_series(1, len(k) - 4)) AS p FROM f WHERE len(k) >= 5)),
m AS (SELECT a.id AS a, b.id AS b, a.pos AS pa, b.pos - a.pos AS d FROM w a JOIN w b ON a.h = b.h AND a.id < b.id), i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, d ORDER BY pa) AS k FROM m)
SELECT a, b, CAST(min(pa) AS INTEGER) AS a_from, CAST(min(pa) + d AS INTEGER) AS b_from, CAST(max(pa) - min(pa) + 5 AS INTEGER) AS length FROM i GROUP BY a, b, d, k""")
def clone_maximal_spans(spark, d):
    rows = t(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.filter(F.split("text", " "), lambda x: x != "").alias("toks"))
    return text.clone_spans(rows, 5)


# ---- provenance --------------------------------------------------------------

CLASSES = """c AS (SELECT o_orderkey AS commit_id, o_orderpriority AS body, c_mktsegment AS author FROM orders JOIN customer ON c_custkey = o_custkey),
 k AS (SELECT commit_id, CASE WHEN author LIKE '%BUILD%' THEN 'builder' WHEN author LIKE '%MACHIN%' OR lower(body) LIKE '%medium%' THEN 'machine'
 WHEN regexp_matches(lower(body), '(^|[^\\p{L}\\p{N}])urgent($|[^\\p{L}\\p{N}])') THEN 'urgent' WHEN commit_id % 10 = 0 THEN 'agent?' ELSE 'unknown' END AS class,
 CASE WHEN author LIKE '%BUILD%' OR author LIKE '%MACHIN%' OR lower(body) LIKE '%medium%' THEN 0.95 WHEN regexp_matches(lower(body), '(^|[^\\p{L}\\p{N}])urgent($|[^\\p{L}\\p{N}])') THEN 0.85 WHEN commit_id % 10 = 0 THEN 0.35 ELSE 0.0 END::DOUBLE AS confidence FROM c)"""


def classes(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("author"))
    commits = t(spark, d, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("commit_id"), "author", F.col("o_orderpriority").alias("body"))
    labels = spark.createDataFrame([(1, "builder", "build"), (2, "machine", "machin"), (3, "machine", "medium")], "ord int, label string, needle string")
    return provenance.classify(commits, labels, ("urgent",), F.col("commit_id") % 10 == 0)


@query(f"WITH {CLASSES} SELECT commit_id, class, confidence FROM k")
def provenance_class_precedence(spark, d):
    return classes(spark, d)


@query(f"""WITH {CLASSES}, s AS (SELECT l_orderkey AS commit_id, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY 1)
SELECT class, count(*) AS commits, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, min(confidence) AS confidence FROM k LEFT JOIN s USING (commit_id) GROUP BY 1""")
def churn_and_confidence_by_class(spark, d):
    touched = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"))
    return provenance.by_class(classes(spark, d), touched)


@query("""WITH a AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages), r AS (SELECT DISTINCT CASE WHEN page_id % 3 = 0 THEN regexp_extract(url, '^(https?://[^/]+/[^/]*)', 1) ELSE regexp_extract(url, '^(https?://[^/]+/)', 1) END AS root FROM pages)
SELECT page_id, (SELECT arg_max(root, (length(root), root)) FROM r WHERE root <> '' AND starts_with(url, root)) AS owner FROM a""")
def longest_prefix_owner(spark, d):
    """The most specific root that a page's URL begins with: hosts, and of one page in three the first segment too. The equi key is the host, so no page meets all roots."""
    host = F.regexp_extract("path", "^https?://([^/]+)", 1)
    pages = t(spark, d, "pages").select("page_id", F.col("url").alias("path")).withColumn("host", host)
    root = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("path", "^(https?://[^/]+/[^/]*)", 1)).otherwise(F.regexp_extract("path", "^(https?://[^/]+/)", 1))
    roots = pages.select(root.alias("root"), "host").where("root <> ''").distinct()
    return structure.owner_by_prefix(pages, roots, "host").select("page_id", "owner")


@query("""WITH c AS (SELECT l_partkey AS file, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1), v AS (SELECT l_partkey AS file, l_linenumber AS line, max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS hits FROM lineitem GROUP BY 1, 2),
f AS (SELECT p_partkey AS file, p_name AS name, p_size AS cyclomatic, 2 AS a, 5 AS b FROM part)
SELECT f.file, name, cyclomatic, churn, count(*) FILTER (hits = 0) / count(*) AS uncovered FROM f JOIN c USING (file) JOIN v ON v.file = f.file AND line BETWEEN a AND b WHERE cyclomatic >= 10 AND churn >= 5 GROUP BY ALL HAVING count(*) FILTER (hits = 0) / count(*) > 0.2""")
def untested_hotspot_range_join(spark, d):
    """The share of uncovered lines that these tables have is small, so the limit is 0.2 here."""
    li = t(spark, d, "lineitem")
    churn = li.groupBy(F.col("l_partkey").alias("file")).agg(F.countDistinct("l_orderkey").alias("churn"))
    hits = F.max(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("hits")
    lines = li.groupBy(F.col("l_partkey").alias("file"), F.col("l_linenumber").alias("line")).agg(hits)
    functions = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.col("p_name").alias("name"), F.col("p_size").alias("cyclomatic"), F.lit(2).alias("start_line"), F.lit(5).alias("end_line"))
    return structure.untested_hotspots(functions, churn, lines, uncovered=0.2)
