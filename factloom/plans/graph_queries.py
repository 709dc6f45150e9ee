"""Queries over call graphs: why an item is live, what is dead, components and cycles.

The call graph's nodes are orders: each calls its customer's next order, the one after it if it is open, and the one before if it is of
low priority. Crates are years, test code is what has no priority, entry points are urgent orders (of production) and those of high priority (of tests).
Importing this module adds the queries to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import flow
from .catalogue import TRADE, query, t, trade


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, kind, test."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("src"), "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "src")
    o = o.withColumns({"n1": F.lead("src").over(order), "n2": F.lead("src", 2).over(order), "p1": F.lag("src").over(order)})
    to = F.array(
        F.struct(F.col("n1").alias("dst"), F.lit("static").alias("kind")),
        F.struct(F.when(F.col("o_orderstatus") == "O", F.col("n2")).alias("dst"), F.lit("dynamic").alias("kind")),
        F.struct(F.when(F.col("o_orderpriority") == "5-LOW", F.col("p1")).alias("dst"), F.lit("dynamic").alias("kind")),
    )
    found = o.select("src", (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("test"), F.explode(to).alias("c"))
    return found.where("c.dst is not null").select("src", "c.dst", "c.kind", "test")


CALLS = """o AS (SELECT *, lead(o_orderkey) OVER w AS n1, lead(o_orderkey, 2) OVER w AS n2, lag(o_orderkey) OVER w AS p1 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
 calls AS MATERIALIZED (SELECT o_orderkey AS src, dst, kind, o_orderpriority = '4-NOT SPECIFIED' AS test FROM
  (SELECT *, n1 AS dst, 'static' AS kind FROM o UNION ALL SELECT *, n2, 'dynamic' FROM o WHERE o_orderstatus = 'O' UNION ALL SELECT *, p1, 'dynamic' FROM o WHERE o_orderpriority = '5-LOW') WHERE dst IS NOT NULL)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """node, test."""
    o = t(spark, d, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    return o.select(F.col("o_orderkey").alias("node"), (F.col("o_orderpriority") == "2-HIGH").alias("test"))


#: Depths by union of all walks up to the longest customer's number of orders; callers by the least one nearer.
LIVE = (
    CALLS
    + """, entry AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT'),
 reach(node, depth) AS (SELECT node, 0 FROM entry UNION SELECT dst, depth + 1 FROM reach JOIN calls ON src = node WHERE depth < 40 AND dst NOT IN (SELECT node FROM entry)),
 live AS MATERIALIZED (SELECT node, min(depth) AS depth FROM reach GROUP BY 1),
 parents AS MATERIALIZED (SELECT a.node, a.depth, min(b.node) AS caller FROM live a LEFT JOIN calls ON dst = a.node LEFT JOIN live b ON b.node = src AND b.depth = a.depth - 1 GROUP BY 1, 2)"""
)


@query(f"""WITH RECURSIVE {LIVE} SELECT p.node, p.depth::INTEGER AS depth, p.caller, min(kind) AS kind FROM parents p LEFT JOIN calls ON src = caller AND dst = node GROUP BY 1, 2, 3""")
def why_live_callers(spark, d):
    """Every live order with the caller that its shortest chain to an entry point goes on with."""
    return flow.live_from(calls(spark, d), entries(spark, d).where("not test"))


@query(f"""WITH RECURSIVE {LIVE}, steps(target, step, node) AS (SELECT node, 0, node FROM parents UNION ALL SELECT target, step + 1, caller FROM steps JOIN parents USING (node) WHERE caller IS NOT NULL)
SELECT target, step::INTEGER AS step, node FROM steps""")
def why_live_chains(spark, d):
    """The whole chain of every live order."""
    live = flow.live_from(calls(spark, d), entries(spark, d).where("not test"))
    return flow.chain_steps(live, live.select("node"))


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT o_orderkey AS node, o_orderpriority = '2-HIGH' AS test FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')),
production(node) AS (SELECT node FROM e WHERE NOT test UNION SELECT dst FROM production JOIN calls ON src = node WHERE NOT test),
whole(node) AS (SELECT node FROM e UNION SELECT dst FROM whole JOIN calls ON src = node),
items AS (SELECT o_orderkey AS node, year(o_orderdate) AS crate, year(o_orderdate) % 2 = 0 AS published FROM orders),
used AS (SELECT dst AS node, bool_or(NOT test) AS by_code FROM calls JOIN items a ON a.node = src JOIN items b ON b.node = dst WHERE a.crate <> b.crate GROUP BY 1),
m AS (SELECT i.*, p.node IS NOT NULL AS prod, w.node IS NOT NULL AS any_, u.node IS NOT NULL AS used_any, coalesce(by_code, false) AS used FROM items i LEFT JOIN (SELECT DISTINCT node FROM production) p USING (node) LEFT JOIN (SELECT DISTINCT node FROM whole) w USING (node) LEFT JOIN used u USING (node))
SELECT node, crate::INTEGER AS crate, CASE WHEN published THEN 'unused-pub-api' ELSE 'unused-pub-workspace' END AS rule FROM m WHERE NOT used AND NOT prod
UNION ALL SELECT node, crate::INTEGER, 'test-only-pub' FROM m WHERE NOT used_any AND NOT prod AND any_""")
def dead_public_items(spark, d):
    """Three rules from one loop of reachability bits."""
    items = t(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.year("o_orderdate").alias("crate"), (F.year("o_orderdate") % 2 == 0).alias("published"))
    return flow.dead_items(items, calls(spark, d).drop("kind"), entries(spark, d))


@query(f"""WITH RECURSIVE {CALLS}, reach(a, b) AS (SELECT src, dst FROM calls UNION SELECT a, dst FROM reach JOIN calls ON src = b),
mutual AS (SELECT r.a AS node, min(r.b) AS least FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY 1), ends AS (SELECT src AS node FROM calls UNION SELECT dst FROM calls)
SELECT node, least(node, coalesce(least, node)) AS component FROM ends LEFT JOIN mutual USING (node)""")
def call_components(spark, d):
    """Strongly connected components of the call graph."""
    return flow.components(calls(spark, d))


@query(f"""WITH RECURSIVE {TRADE}, walk(root, node, path) AS (SELECT src, dst, [src] FROM trade WHERE dst >= src
 UNION ALL SELECT root, dst, list_append(path, node) FROM walk JOIN trade ON src = node WHERE node > root AND dst >= root AND NOT list_contains(path, node))
SELECT DISTINCT array_to_string(path, ',') AS cycle, CAST(len(path) AS INTEGER) AS length FROM walk WHERE node = root""")
def all_simple_cycles(spark, d):
    """All cycles of the trade graph, without a bound on their length."""
    c = flow.simple_cycles(trade(spark, d))
    return c.select(F.array_join(F.col("cycle").cast("array<string>"), ",").alias("cycle"), "length")


@query(f"""WITH RECURSIVE {CALLS}, e AS (SELECT src, dst FROM calls UNION ALL SELECT o_orderkey, o_orderkey + 1000000 FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 499 = 0),
u AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), reach(a, b) AS (SELECT src, dst FROM u UNION SELECT a, dst FROM reach JOIN u ON src = b),
mutual AS (SELECT r.a AS node, least(r.a, min(r.b)) AS c FROM reach r JOIN reach s ON s.a = r.b AND s.b = r.a GROUP BY 1),
inner_ AS (SELECT src, dst, x.c FROM u JOIN mutual x ON x.node = src JOIN mutual y ON y.node = dst WHERE x.c = y.c),
walk(c, node, path) AS (SELECT DISTINCT c, c, [c] FROM inner_ UNION ALL SELECT w.c, dst, list_append(path, dst) FROM walk w JOIN inner_ i ON i.src = w.node AND i.c = w.c WHERE len(path) < 40 AND NOT list_contains(path, dst)),
short AS (SELECT c, node, arg_min(path, (len(path), list_reverse(path))) AS path FROM walk GROUP BY 1, 2),
closed AS (SELECT short.c, arg_min(path, (len(path), node)) AS path FROM short JOIN inner_ i ON i.src = node AND i.dst = short.c AND i.c = short.c GROUP BY 1)
SELECT 'duplicate_edge' AS error, concat(src, ' -> ', dst) AS id, count(*)::VARCHAR AS detail FROM e GROUP BY src, dst HAVING count(*) > 1
UNION ALL SELECT 'unknown_finding', dst::VARCHAR, NULL FROM (SELECT DISTINCT dst FROM e WHERE dst NOT IN (SELECT o_orderkey FROM orders))
UNION ALL SELECT DISTINCT 'cycle', src::VARCHAR, concat(src, ' -> ', dst) FROM e WHERE src = dst
UNION ALL SELECT 'cycle', c::VARCHAR, array_to_string(list_append(path, c), ' -> ') FROM closed""")
def finding_graph_errors(spark, d):
    """The call graph as causes of findings, with an edge to a finding that isn't there and one to itself now and then: what is wrong with it, cycles by name."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    unknown = o.where("id % 97 = 0").select(F.col("id").alias("cause"), (F.col("id") + 1000000).alias("effect"))
    itself = o.where("id % 499 = 0").select(F.col("id").alias("cause"), F.col("id").alias("effect"))
    edges = calls(spark, d).select(F.col("src").alias("cause"), F.col("dst").alias("effect")).unionByName(unknown).unionByName(itself)
    return flow.graph_errors(o, edges)
