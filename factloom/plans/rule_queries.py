"""More queries over the driver's tables: names and versions, manifests, boundaries, structure, the stream of findings.

Importing this module adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.rust_source import usage_domain
from ..operators import boundaries, decide, findings, graphs, manifests, provenance, structure
from ..sources.shared import Stored
from . import catalogue
from .catalogue import CLASSES, PATHS, TRADE, classes, layers, query, t, trade

# ---- names, paths, versions --------------------------------------------------


@query("""SELECT s_suppkey AS id, replace(lower(s_name), '#', '_') AS ident, regexp_replace(s_name, '[0-9]+$', '') AS stem, lower(split_part(s_name, '#', 1)) IN ('data', 'result', 'temp', 'handler', 'manager', 'processor', 'helper', 'utils') AS generic,
CASE s_suppkey % 5 WHEN 0 THEN '1/a' WHEN 1 THEN '2/ab' WHEN 2 THEN '3/a/abc' WHEN 3 THEN 'ab/cd/abcd' ELSE 'ab/cd/abcde' END AS shard, s_suppkey % 4 = 0 AS keyword FROM supplier""")
def name_functions(spark, d):
    s = t(spark, d, "supplier")
    rows = s.select(
        F.col("s_suppkey").alias("id"),
        F.replace("s_name", F.lit("#"), F.lit("-")).alias("dashed"),
        "s_name",
        F.substring_index("s_name", "#", 1).alias("head"),
        F.substring(F.lit("ABCDE"), F.lit(1), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("crate"),
        F.when(F.col("s_suppkey") % 4 == 0, "match").otherwise("matches").alias("word"),
    )
    return rows.select("id", names.normalised("dashed").alias("ident"), names.without_trailing_digits("s_name").alias("stem"), names.is_generic("head").alias("generic"), names.index_path("crate").alias("shard"), names.is_keyword("word").alias("keyword"))


_PATH = """CASE p_partkey % 8 WHEN 0 THEN 'src/lib.rs' WHEN 1 THEN 'src/bin/m' || p_size || '.rs' WHEN 2 THEN 'src/m' || p_size || '/mod.rs' WHEN 3 THEN 'src/m' || p_size || '/k.rs'
 WHEN 4 THEN 'build.rs' WHEN 5 THEN 'tests/t' || p_size || '.rs' WHEN 6 THEN 'src/notes.md' ELSE 'src/m' || p_size || '.rs' END"""


@query("""SELECT p_partkey AS file, CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'm' || p_size WHEN 3 THEN 'm' || p_size || '::k' WHEN 7 THEN 'm' || p_size END AS module,
CASE p_partkey % 8 WHEN 4 THEN 'Build' WHEN 5 THEN 'Dev' ELSE 'Normal' END AS domain FROM part""")
def module_paths(spark, d):
    files = t(spark, d, "part").select(F.col("p_partkey").alias("file"), F.expr(_PATH).alias("path"))
    return files.select("file", names.module_path("path").alias("module"), usage_domain("path").alias("domain"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'crate::a' WHEN 1 THEN 'm' || p_size || '::a' WHEN 2 THEN 'a' END AS path FROM (SELECT p_partkey, p_size FROM part) WHERE p_partkey % 4 <> 3 AND p_partkey % 4 <> 0
UNION ALL SELECT p_partkey, 'a' FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_partkey % 4 = 3""")
def resolved_module_references(spark, d):
    """crate::a, super::a within m1::k, super::super::a within m1::k, and a name that can't be told."""
    module = F.concat(F.lit("m"), F.col("p_size"), F.lit("::k"))
    written = F.when(F.col("p_partkey") % 4 == 0, "crate::a").when(F.col("p_partkey") % 4 == 1, "super::a").when(F.col("p_partkey") % 4 == 2, "super::super::a").otherwise("serde::a")
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), module.alias("module"), F.split(written, "::").alias("segments"))
    return rows.select("id", F.array_join(names.resolved_segments("module", "segments"), "::").alias("path"))


@query("""WITH v AS (SELECT p_partkey AS id, p_size % 3 AS a, p_partkey % 4 AS b, p_partkey % 7 AS c FROM part)
SELECT id, CASE WHEN a > 0 THEN a || '.0.0' WHEN b > 0 THEN '0.' || b || '.0' ELSE '0.0.' || CASE WHEN c = 6 THEN 0 ELSE c END END AS bucket FROM v WHERE c <> 5""")
def version_buckets(spark, d):
    """Two-part versions (the patch counts as 0) where the patch would be 6, and no versions at all, which have no row, where it would be 5."""
    a, b, c = F.col("p_size") % 3, F.col("p_partkey") % 4, F.col("p_partkey") % 7
    raw = F.when(c == 5, F.concat_ws(".", a, b, F.lit("x"))).when(c == 6, F.concat_ws(".", a, b)).otherwise(F.concat_ws(".", a, b, c))
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")).withColumn("v", names.version("raw")).where("v is not null")
    bucket = rows.select("id", names.compatible_with("v").alias("b"))
    return bucket.select("id", F.concat_ws(".", "b.major", "b.minor", "b.patch").alias("bucket"))


@query("""WITH r AS (SELECT c_custkey AS krate, 'n' || (c_custkey % 30) AS name, c_custkey % 8 AS kind, c_nationkey % 3 AS a, c_custkey % 4 AS b, c_custkey % 5 AS c FROM customer),
p AS (SELECT 'n' || (p_partkey % 30) AS name, p_size % 3 AS a, CAST(floor(p_retailprice) AS BIGINT) % 4 AS b, p_partkey % 5 AS c FROM part WHERE p_size % 4 <> 0 AND p_partkey < 200),
m AS (SELECT krate, r.name, bool_or(CASE kind WHEN 0 THEN CASE WHEN r.a > 0 THEN p.a = r.a AND (p.b, p.c) >= (r.b, r.c) WHEN r.b > 0 THEN p.a = 0 AND p.b = r.b AND p.c >= r.c ELSE p.a = 0 AND p.b = 0 AND p.c = r.c END
 WHEN 1 THEN p.a = r.a AND p.b = r.b AND p.c >= r.c WHEN 2 THEN (p.a, p.b, p.c) = (r.a, r.b, r.c) WHEN 3 THEN (p.a, p.b, p.c) >= (r.a, r.b, r.c) WHEN 4 THEN (p.a, p.b, p.c) < (r.a, r.b, r.c)
 WHEN 5 THEN p.a = r.a AND p.b = r.b WHEN 6 THEN p.a > r.a ELSE (p.a, p.b, p.c) >= (r.a, r.b, r.c) AND p.a < 2 END) AS met FROM r LEFT JOIN p ON p.name = r.name WHERE r.name IN (SELECT 'n' || (p_partkey % 30) FROM part WHERE p_partkey < 200) GROUP BY ALL)
SELECT krate, name FROM m WHERE NOT coalesce(met, false)""")
def phantom_version(spark, d):
    """Requirements of each sign, a wildcard and a list, over the versions of the first 200 parts, which are the registry here."""
    a, b, c = F.col("c_nationkey") % 3, F.col("c_custkey") % 4, F.col("c_custkey") % 5
    three = F.concat_ws(".", a, b, c)
    kind = F.col("c_custkey") % 8
    written = (
        F.when(kind == 0, three)
        .when(kind == 1, F.concat(F.lit("~"), three))
        .when(kind == 2, F.concat(F.lit("="), three))
        .when(kind == 3, F.concat(F.lit(">="), three))
        .when(kind == 4, F.concat(F.lit("<"), three))
        .when(kind == 5, F.concat(a, F.lit("."), b, F.lit(".*")))
        .when(kind == 6, F.concat(F.lit("> "), a))
        .otherwise(F.concat(F.lit(">="), three, F.lit(", <2")))
    )
    declared = t(spark, d, "customer").select(F.col("c_custkey").alias("krate"), F.concat(F.lit("n"), F.col("c_custkey") % 30).alias("name"), written.alias("requirement"))
    v = F.struct((F.col("p_size") % 3).alias("major"), (F.col("p_retailprice").cast("bigint") % 4).alias("minor"), (F.col("p_partkey") % 5).alias("patch"))
    published = t(spark, d, "part").where("p_partkey < 200").select(F.concat(F.lit("n"), F.col("p_partkey") % 30).alias("name"), v.alias("v"), (F.col("p_size") % 4 == 0).alias("yanked"))
    return manifests.phantom_versions(declared, published).select("krate", "name")


@query("""WITH l AS (SELECT l_orderkey AS file, l_linenumber AS line, CASE l_partkey % 4 WHEN 0 THEN 'Step ' || l_linenumber || ': go' WHEN 1 THEN 'STEP' || l_linenumber WHEN 2 THEN 'Stepping 3' ELSE '1) no' END AS s FROM lineitem)
SELECT file, line, s, CASE WHEN regexp_matches(s, '^(Step |STEP)[0-9]') THEN line END AS number FROM l""")
def step_numbers(spark, d):
    kind = F.col("l_partkey") % 4
    s = F.when(kind == 0, F.concat(F.lit("Step "), F.col("l_linenumber"), F.lit(": go"))).when(kind == 1, F.concat(F.lit("STEP"), F.col("l_linenumber"))).when(kind == 2, "Stepping 3").otherwise("1) no")
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), s.alias("s"))
    return rows.select("*", names.step_number("s").alias("number"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) END AS seconds FROM events")
def stamp_seconds(spark, d):
    stamp = F.when(F.col("event_id") % 3 == 0, "2024-01").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'.000Z'"))
    return t(spark, d, "events").select(F.col("event_id").alias("id"), stamp.alias("s")).select("id", names.seconds_of("s").alias("seconds"))


# ---- manifests ---------------------------------------------------------------

_DEPS = """deps AS (SELECT DISTINCT l_suppkey AS krate, 'd' || (l_partkey % 40) AS name, CASE l_linenumber % 3 WHEN 0 THEN 'dev' WHEN 1 THEN 'normal' ELSE 'build' END AS kind, (l_partkey % 40) % 3 AS features FROM lineitem WHERE l_linenumber <= 3),
 used AS (SELECT DISTINCT l_suppkey AS krate, CASE WHEN l_partkey % 7 <> 0 AND l_orderkey % 3 = 0 THEN 'd' ELSE 'own' END || (l_partkey % 40) AS name, CASE l_linenumber WHEN 4 THEN 'Normal' WHEN 5 THEN 'Dev' ELSE 'Build' END AS domain FROM lineitem WHERE l_linenumber > 3),
 d AS (SELECT deps.*, count(domain) > 0 AS any_, count(*) FILTER (domain = 'Normal') > 0 AS n, count(*) FILTER (domain = 'Dev') > 0 AS v, count(*) FILTER (domain = 'Build') > 0 AS b, krate % 10 = 3 AS blind,
 (SELECT count(*) FROM deps o WHERE o.krate = deps.krate AND o.name = deps.name AND o.kind <> 'dev') > 0 AS elsewhere FROM deps LEFT JOIN used USING (krate, name) GROUP BY ALL)"""


@query(f"""WITH {_DEPS} SELECT krate, name, 'unused-feature-flag' AS rule, 'f' || unnest(range(1, features + 1)) AS feature FROM d WHERE NOT any_ AND NOT blind AND features > 0
UNION ALL SELECT krate, name, 'default-features-unused', NULL FROM d WHERE NOT any_ AND NOT blind AND features = 1
UNION ALL SELECT krate, name, 'unused-dev-dependency', NULL FROM d WHERE NOT (NOT any_ AND NOT blind AND features > 0) AND kind = 'dev' AND NOT v AND NOT blind AND NOT elsewhere
UNION ALL SELECT krate, name, 'misplaced-dependency-kind', NULL FROM d WHERE NOT (NOT any_ AND NOT blind AND features > 0) AND ((kind = 'normal' AND v AND NOT n AND features <= 1 AND NOT blind) OR (kind = 'build' AND NOT b))""")
def dependency_findings(spark, d):
    """An order's first three lines declare dependencies, the others name identifiers, of which two of seven are a dependency's."""
    li = t(spark, d, "lineitem").withColumn("name", F.concat(F.lit("d"), F.col("l_partkey") % 40))
    kind = F.element_at(F.array(F.lit("dev"), F.lit("normal"), F.lit("build")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    n = (F.col("l_partkey") % 40 % 3).cast("int")
    flags = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("f"), i))).otherwise(F.array().cast("array<string>"))
    deps = li.where("l_linenumber <= 3").select(F.col("l_suppkey").alias("krate"), "name", F.col("name").alias("ident"), kind.alias("kind"), flags.alias("features"), (n == 1).alias("explicit_defaults")).distinct()
    domain = F.when(F.col("l_linenumber") == 4, "Normal").when(F.col("l_linenumber") == 5, "Dev").otherwise("Build")
    ident = F.when((F.col("l_partkey") % 7 != 0) & (F.col("l_orderkey") % 3 == 0), F.col("name")).otherwise(F.concat(F.lit("own"), F.col("l_partkey") % 40))
    usage = li.where("l_linenumber > 3").select(F.col("l_suppkey").alias("krate"), ident.alias("ident"), domain.alias("domain"))
    failed = t(spark, d, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("krate"), F.lit("Normal").alias("domain"))
    return manifests.dependency_findings(deps, usage, failed)


@query("""WITH f AS (SELECT DISTINCT p_brand AS krate, 'f' || p_size AS feature FROM part WHERE p_size % 5 <> 0), x AS (SELECT p_brand AS krate, 'f' || ((p_partkey * 7) % 50) AS feature FROM part WHERE p_partkey % 3 <> 0)
SELECT krate, feature FROM f WHERE (krate, feature) NOT IN (SELECT krate, feature FROM x)""")
def unused_features(spark, d):
    part = t(spark, d, "part")
    implied = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("f1"))).otherwise(F.array().cast("array<string>"))
    features = part.select(F.col("p_brand").alias("krate"), F.concat(F.lit("f"), F.col("p_size")).alias("feature"), implied.alias("implied")).distinct()
    asked = F.concat(F.lit("f"), F.col("p_partkey") * 7 % 50)
    body = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('feature: "'), asked, F.lit('"'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('#[cfg(feature = "'), asked, F.lit('")]'))).otherwise(F.concat(F.lit('feature="'), asked, F.lit('"')))
    return manifests.unused_features(features, part.select(F.col("p_brand").alias("krate"), body.alias("text")))


@query(f"""WITH RECURSIVE {TRADE}, reach(start, node) AS (SELECT src, dst FROM trade UNION SELECT start, dst FROM reach JOIN trade ON src = node), n AS (SELECT start AS name, count(*) AS transitive FROM reach GROUP BY 1),
deps AS (SELECT DISTINCT s_suppkey AS krate, CAST(s_nationkey AS BIGINT) AS name FROM supplier), u AS (SELECT l_suppkey AS krate, l_partkey % 25 AS name, count(DISTINCT l_linenumber) AS used FROM lineitem GROUP BY 1, 2)
SELECT deps.krate, deps.name, transitive, coalesce(used, 0) AS used FROM deps JOIN n USING (name) LEFT JOIN u ON u.krate = deps.krate AND u.name = deps.name WHERE transitive > 4 AND coalesce(used, 0) < 8""")
def heavy_dependency(spark, d):
    """The limits suit these tables' small graph: more than 4 packages for fewer than 8 items."""
    deps = t(spark, d, "supplier").select(F.col("s_suppkey").alias("krate"), F.col("s_nationkey").cast("bigint").alias("name"))
    used = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("krate"), (F.col("l_partkey") % 25).alias("name"), F.col("l_linenumber").alias("item"))
    return manifests.heavy(deps, graphs.closure_size(trade(spark, d)).withColumnsRenamed({"node": "name", "reachable": "transitive"}), used, 4, 8)


@query("SELECT p_partkey AS name FROM part WHERE p_partkey % 10 <> 0 AND (1, p_size, 0) > (1, 40, 0)")
def msrv_drift(spark, d):
    raw = F.concat_ws(".", F.lit(1), F.col("p_size"))
    packages = t(spark, d, "part").select(F.col("p_partkey").alias("name"), raw.alias("raw"), (F.col("p_partkey") % 10 == 0).alias("member")).withColumn("needs", names.version("raw"))
    promise = F.struct(F.lit(1).alias("major"), F.lit(40).alias("minor"), F.lit(0).alias("patch"))
    return manifests.above_promise(packages, promise).select("name")


@query(f"WITH {TRADE} SELECT dst AS name, array_to_string(list_sort(list(DISTINCT CAST(src AS VARCHAR))), ',') AS requirers FROM trade GROUP BY 1")
def direct_requirers(spark, d):
    return manifests.requirers(trade(spark, d))


@query("""WITH f AS (SELECT DISTINCT p_brand AS krate, p_size % 6 AS src, (p_size * 2 + 1) % 8 AS dst FROM part), e AS (SELECT * FROM f WHERE (krate, dst) IN (SELECT krate, src FROM f))
SELECT DISTINCT krate, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM e""")
def feature_implication_graph(spark, d):
    own, other = (F.col("p_size") % 6).cast("string"), ((F.col("p_size") * 2 + 1) % 8).cast("string")
    features = t(spark, d, "part").select(F.col("p_brand").alias("krate"), own.alias("feature"), other.alias("x")).groupBy("krate", "feature").agg(F.collect_set("x").alias("implied"))
    return manifests.feature_edges(features)


# ---- boundaries --------------------------------------------------------------


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).withColumnRenamed("layer", "grp")


_GROUPS = "g AS (SELECT CAST(n_nationkey AS BIGINT) AS node, n_regionkey AS grp FROM nation)"


@query(f"""WITH RECURSIVE {PATHS}, {_GROUPS} SELECT 'preset:layered:' || a.grp AS rule, start AS src, node AS dst, array_to_string(path, '>') AS path FROM best JOIN g a ON a.node = start JOIN g b USING (node) WHERE a.grp < b.grp""".replace("JOIN g b USING (node)", "JOIN g b ON b.node = best.node").replace("node AS dst", "best.node AS dst"))
def preset_layered(spark, d):
    return boundaries.violations(trade(spark, d), boundaries.layered(_assigned(spark, d), [0, 1, 2, 3, 4]))


_ROLES = "h AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CASE WHEN n_regionkey = 0 THEN 'core' WHEN n_regionkey = 1 THEN 'ports' ELSE 'adapters' END AS grp FROM nation)"


@query(f"""WITH {TRADE}, {_ROLES} SELECT 'preset:hexagonal:' || a.grp AS rule, src, dst, src || '>' || dst AS path FROM trade JOIN h a ON a.node = src JOIN h b ON b.node = dst WHERE (a.grp, b.grp) IN (('core', 'adapters'), ('adapters', 'core'))
UNION ALL SELECT 'preset:hexagonal:adapters', node, NULL, NULL FROM h WHERE grp = 'adapters' AND node NOT IN (SELECT src FROM trade JOIN h b ON b.node = dst WHERE b.grp = 'ports')""")
def preset_hexagonal(spark, d):
    role = F.when(F.col("grp") == 0, "core").when(F.col("grp") == 1, "ports").otherwise("adapters")
    return boundaries.violations(trade(spark, d), boundaries.hexagonal(_assigned(spark, d).withColumn("grp", role)))


@query(f"""WITH RECURSIVE {PATHS}, {_GROUPS} SELECT 'preset:feature-sliced:' || a.grp AS rule, start AS src, best.node AS dst, array_to_string(path, '>') AS path FROM best JOIN g a ON a.node = start JOIN g b ON b.node = best.node WHERE a.grp <> b.grp AND a.grp <> 4 AND b.grp <> 4""")
def preset_feature_sliced(spark, d):
    return boundaries.violations(trade(spark, d), boundaries.feature_sliced(_assigned(spark, d), 4))


@query("""WITH r AS (SELECT l_orderkey AS file, l_linenumber AS line, 'm' || (l_orderkey % 9) AS module, CASE l_partkey % 3 WHEN 0 THEN 'm' || (l_partkey % 10) || '::x' WHEN 1 THEN 'm' || (l_suppkey % 10) END AS "to" FROM lineitem),
k(name, below, forbidden) AS (VALUES ('a', 'm1', 'm2'), ('a', 'm1', 'm3::x'), ('b', 'm4', 'm5'))
SELECT name AS rule, file, min(line) AS line, arg_min(forbidden, (line, forbidden)) AS forbidden FROM r JOIN k ON module = below AND ("to" = forbidden OR starts_with("to", forbidden || '::')) GROUP BY 1, 2""")
def module_boundary_violation(spark, d):
    kind = F.col("l_partkey") % 3
    written = F.when(kind == 0, F.concat(F.lit("crate::m"), F.col("l_partkey") % 10, F.lit("::x"))).when(kind == 1, F.concat(F.lit("super::m"), F.col("l_suppkey") % 10)).otherwise("m2::x")
    references = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.concat(F.lit("m"), F.col("l_orderkey") % 9).alias("module"), F.col("l_linenumber").alias("line"), F.split(written, "::").alias("segments"))
    rules = spark.createDataFrame([("a", "m1", "m2"), ("a", "m1", "m3::x"), ("b", "m4", "m5")], "name string, below string, forbidden string")
    return boundaries.module_violations(references, rules)


@query(f"""WITH RECURSIVE {TRADE}, reach(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM reach JOIN trade ON src = node) SELECT CAST(n_nationkey AS BIGINT) AS file FROM nation WHERE n_nationkey NOT IN (SELECT node FROM reach)""")
def unlinked_files(spark, d):
    files = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("file"))
    return structure.unlinked_files(files, trade(spark, d), spark.range(1).select(F.col("id").alias("node")))


@query("""WITH m AS (SELECT DISTINCT c_nationkey AS krate, 'm' || (c_custkey % 12) AS top, CASE WHEN c_custkey % 2 = 0 THEN 'm' || (c_custkey % 12) ELSE 'm' || (c_custkey % 12) || '::k' END AS module, c_custkey AS file FROM customer),
a AS (SELECT DISTINCT krate, module FROM m), r AS (SELECT c_nationkey AS krate, o_custkey AS file, CASE WHEN o_orderkey % 40 = 0 THEN 'm' ELSE 'other' END || (o_orderkey % 12) || CASE WHEN o_orderkey % 5 = 0 THEN '::k' ELSE '' END AS "to" FROM orders JOIN customer ON c_custkey = o_custkey),
o AS (SELECT DISTINCT a.krate, a.module FROM a JOIN r ON r.krate = a.krate AND (r."to" = a.module OR starts_with(r."to", a.module || '::')) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.krate = a.krate AND m.file = r.file AND (m.module = a.module OR starts_with(m.module, a.module || '::')))),
e AS (SELECT DISTINCT a.krate, a.module FROM a JOIN m ON m.krate = a.krate AND m.file % 90 = 0 AND (m.module = a.module OR starts_with(m.module, a.module || '::')))
SELECT krate, module FROM a WHERE (krate, module) NOT IN (SELECT krate, module FROM o) AND (krate, module) NOT IN (SELECT krate, module FROM e)""")
def orphan_modules(spark, d):
    """One reference in forty is to a module of the crate, the others to none of its."""
    c = t(spark, d, "customer")
    top = F.concat(F.lit("m"), F.col("c_custkey") % 12)
    modules = c.select(F.col("c_nationkey").alias("krate"), F.when(F.col("c_custkey") % 2 == 0, top).otherwise(F.concat(top, F.lit("::k"))).alias("module"), F.col("c_custkey").alias("file"))
    to = F.concat(F.when(F.col("o_orderkey") % 40 == 0, "m").otherwise("other"), F.col("o_orderkey") % 12, F.when(F.col("o_orderkey") % 5 == 0, "::k").otherwise(""))
    references = t(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("krate"), to.alias("to"), F.col("o_custkey").alias("file"))
    entries = c.where("c_custkey % 90 = 0").select(F.col("c_nationkey").alias("krate"), F.col("c_custkey").alias("file"))
    return structure.orphan_modules(modules, references, entries)


# ---- structure ---------------------------------------------------------------


@query("""SELECT c_custkey AS builder, c_nationkey AS target, n AS fields FROM customer JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = c_nationkey WHERE n <= 2""")
def inflated_builders(spark, d):
    builders = t(spark, d, "customer").select(F.col("c_custkey").alias("builder"), F.col("c_nationkey").alias("target"))
    return structure.inflated_builders(builders, t(spark, d, "supplier").select(F.col("s_nationkey").alias("type"), F.col("s_suppkey").alias("field")))


@query("SELECT p_partkey AS target FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_orderkey % 100 <> l_partkey % 100 AND l_linenumber = 7)")
def connectivity_drop(spark, d):
    references = t(spark, d, "lineitem").where("l_linenumber = 7").select(F.col("l_partkey").alias("target"), (F.col("l_partkey") % 100).alias("target_file"), (F.col("l_orderkey") % 100).alias("file"))
    return structure.unconnected(t(spark, d, "part").select(F.col("p_partkey").alias("target")), references)


@query("""WITH n AS (SELECT p_brand AS krate, count(*) AS items FROM part GROUP BY 1), o AS (SELECT p_brand AS krate, count(*) AS items FROM part WHERE p_brand <> 'Brand#3' AND p_size < 25 GROUP BY 1)
SELECT krate, n.items, n.items - o.items AS change FROM n LEFT JOIN o USING (krate)""")
def public_item_trend(spark, d):
    count = lambda rows: rows.groupBy(F.col("p_brand").alias("krate")).agg(F.count("*").alias("items"))
    part = t(spark, d, "part")
    return structure.size_trend(count(part), count(part.where("p_brand <> 'Brand#3' and p_size < 25")))


@query("""WITH f AS (SELECT p_brand AS krate, p_partkey AS file, CAST(p_size AS BIGINT) AS lines, p_partkey % 6 AS k FROM part), i AS (SELECT file, CASE WHEN k IN (1, 2) THEN least(lines, 10) ELSE 0 END AS inner_, * FROM f WHERE k <> 5)
SELECT krate, CAST(sum(CASE WHEN k = 0 THEN 0 ELSE lines - inner_ END) AS BIGINT) AS production_loc, CAST(sum(CASE WHEN k = 0 THEN lines ELSE inner_ END) AS BIGINT) AS test_loc,
CAST(sum(CASE WHEN k = 0 THEN lines ELSE inner_ END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN k = 0 THEN 0 ELSE lines - inner_ END) AS DOUBLE), 0) AS ratio FROM i GROUP BY 1""")
def test_ratio_by_crate(spark, d):
    k = F.col("p_partkey") % 6
    files = t(spark, d, "part").select(F.col("p_brand").alias("krate"), F.col("p_partkey").alias("file"), F.col("p_size").cast("bigint").alias("lines"), F.when(k == 0, "Dev").otherwise("Normal").alias("domain"), F.when(k == 5, "Generated").otherwise("Authored").alias("kind"))
    spans = files.where((F.col("file") % 6).isin(1, 2)).select("file", F.lit(1).alias("from_line"), F.least("lines", F.lit(10)).alias("to_line"))
    return structure.test_ratios(files, spans)


# ---- findings ----------------------------------------------------------------

_MARK = "lint-off:"
_LINES = """lines AS (SELECT l_orderkey AS file, l_linenumber AS line, CASE l_partkey % 6 WHEN 0 THEN '// lint-off: r1 — known' WHEN 1 THEN 'go(); // lint-off: r2 -- later' WHEN 2 THEN '// lint-off: r1' WHEN 3 THEN '  // lint-off: r2 - why not' ELSE 'go();' END AS text,
 l_partkey % 6 AS k FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    text_ = F.when(k == 0, f"// {_MARK} r1 — known").when(k == 1, f"go(); // {_MARK} r2 -- later").when(k == 2, f"// {_MARK} r1").when(k == 3, f"  // {_MARK} r2 - why not").otherwise("go();")
    one = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("m"))
    return one.select("file", "line", (F.col("m.l_partkey") % 6).alias("k")).withColumn("text", text_)


@query(f"""WITH {_LINES}, f AS (SELECT file, line, 'r' || (1 + file % 3) AS rule FROM lines), c AS (SELECT file, line, CASE k WHEN 0 THEN 'r1' ELSE 'r2' END AS rule, k <> 1 AS alone FROM lines WHERE k IN (0, 1, 3)),
x AS (SELECT file, line, rule FROM c UNION SELECT file, line + 1, rule FROM c WHERE alone) SELECT file, line, rule FROM f WHERE (file, line, rule) NOT IN (SELECT file, line, rule FROM x)""")
def inline_suppressions(spark, d):
    lines = _lines(spark, d)
    found = lines.select("file", "line", F.concat(F.lit("r"), F.col("file") % 3 + 1).alias("rule"))
    return findings.unsuppressed(found, findings.suppressions(lines, _MARK))[0]


@query(f"WITH {_LINES} SELECT file, line, CASE k WHEN 0 THEN 'r1' WHEN 1 THEN 'r2' WHEN 3 THEN 'r2' END AS rule, k <> 1 AS alone, k = 2 AS error FROM lines WHERE k < 4")
def suppression_comments(spark, d):
    return findings.suppressions(_lines(spark, d), _MARK)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """Findings of nine detectors."""
    c, none = F.col, F.lit(None).cast("string")
    q = catalogue.QUERIES
    make = findings.as_findings
    collisions = q["duplicate_versions"](spark, d)
    touched = Stored(catalogue.touches(spark, d)).frame  # three of them read it
    return findings.all_of(
        [
            make(q["hotspot_top15"](spark, d, touched), "hotspot", [c("file")], c("file"), evidence=c("commits")),
            make(q["churn_hotspot_window"](spark, d, touched), "churn-hotspot", [c("file")], c("file"), evidence=c("commits")),
            make(q["legacy_freeze_siblings"](spark, d, touched), "legacy-freeze", [c("file")], c("file"), evidence=c("active_siblings")),
            make(q["size_distribution_outliers"](spark, d), "size-distribution", [c("file")], c("file"), evidence=c("size")),
            make(q["low_bus_factor_severity"](spark, d), "low-bus-factor", [c("file")], c("file"), item=c("author"), severity=c("severity")),
            make(q["ownership_fragmentation"](spark, d), "ownership-fragmentation", [c("file")], c("file"), evidence=c("authors")),
            make(collisions, "duplicate-crate-versions", [c("name")], F.lit("Cargo.lock"), item=c("name"), evidence=c("found")),
            make(q["change_coupling"](spark, d), "change-coupling-signal", [c("a"), c("b")], F.lit("Cargo.toml"), item=F.concat_ws(" ", "a", "b"), evidence=c("together")),
            make(q["graph_cycles_bounded"](spark, d), "dependency-cycle", [c("cycle")], F.lit("Cargo.toml"), item=c("cycle"), evidence=none),
        ]
    )


def _rows(name: str, rule: str, key: str, severity: str, cls: str, file: str, item: str = "NULL", evidence: str = "NULL") -> str:
    return f"SELECT '{rule}:' || {key} AS id, '{rule}' AS rule, {severity} AS severity, '{cls}' AS evidence_class, CAST({file} AS VARCHAR) AS file, 1 AS line, CAST({item} AS VARCHAR) AS item, CAST({evidence} AS VARCHAR) AS evidence FROM ({catalogue.ORACLES[name]})"


_STREAM = " UNION ALL ".join(
    [
        _rows("hotspot_top15", "hotspot", "file", "'Info'", "heuristic", "file", evidence="commits"),
        _rows("churn_hotspot_window", "churn-hotspot", "file", "'Warn'", "heuristic", "file", evidence="commits"),
        _rows("legacy_freeze_siblings", "legacy-freeze", "file", "'Info'", "heuristic", "file", evidence="active_siblings"),
        _rows("size_distribution_outliers", "size-distribution", "file", "'Info'", "heuristic", "file", evidence="size"),
        _rows("low_bus_factor_severity", "low-bus-factor", "file", "severity", "heuristic", "file", "author"),
        _rows("ownership_fragmentation", "ownership-fragmentation", "file", "'Info'", "heuristic", "file", evidence="authors"),
        _rows("duplicate_versions", "duplicate-crate-versions", "name", "'Warn'", "derived_fact", "'Cargo.lock'", "name", "found"),
        _rows("change_coupling", "change-coupling-signal", "a || ':' || b", "'Warn'", "heuristic", "'Cargo.toml'", "a || ' ' || b", "together"),
        _rows("graph_cycles_bounded", "dependency-cycle", "cycle", "'Warn'", "bounded_semantic", "'Cargo.toml'", "cycle"),
    ]
)


@query(_STREAM)
def all_findings_worst_first(spark, d):
    return findings.worst_first(_stream(spark, d))


@query(f"SELECT rule, severity, evidence_class <> 'heuristic' AS gating, count(*) AS n FROM ({_STREAM}) GROUP BY ALL")
def findings_by_rule(spark, d):
    rows = _stream(spark, d)
    return rows.groupBy("rule", "severity", decide.gates().alias("gating")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'hotspot' WHEN 1 THEN 'phantom-crate' ELSE 'no-such-rule' END AS rule, CASE WHEN o_orderkey % 2 = 0 THEN 'bounded_semantic' WHEN o_custkey % 3 = 1 THEN 'external_measurement' ELSE 'heuristic' END AS evidence_class, 2 AS schema_version FROM orders WHERE o_orderkey % 5 <> 0""")
def baseline_migration(spark, d):
    """Half of the findings are of the first schema, a fifth of one that isn't known."""
    rule = F.element_at(F.array(F.lit("hotspot"), F.lit("phantom-crate"), F.lit("no-such-rule")), (F.col("o_custkey") % 3 + 1).cast("int"))
    version = F.when(F.col("o_orderkey") % 5 == 0, 3).when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1)
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), rule.alias("rule"), F.when(version == 2, "bounded_semantic").alias("evidence_class"), F.lit(0.5).alias("confidence"), version.alias("schema_version"))
    return findings.migrated(rows)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' OR o_custkey % 7 = 0 THEN 'fail' WHEN o_orderstatus = 'O' THEN 'warn' ELSE 'pass' END AS verdict,
CASE WHEN o_orderkey % 50 = 0 THEN 2 WHEN o_orderstatus = 'F' OR o_custkey % 7 = 0 THEN 1 ELSE 0 END AS code FROM orders""")
def verdict_with_gates(spark, d):
    tri = F.when(F.col("o_orderstatus") == "F", "fail").when(F.col("o_orderstatus") == "O", "warn").otherwise("pass")
    gate = F.when(F.col("o_custkey") % 7 == 0, "fail").when(F.col("o_custkey") % 7 == 1, "not_evaluated_small_sample").otherwise("pass")
    rows = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tri.alias("tri"), F.array(gate, F.lit("pass")).alias("gates"), F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0).alias("errors"))
    rows = rows.withColumn("verdict", decide.combined_verdict("tri", "gates"))
    return rows.select("id", "verdict", decide.exit_code("verdict", "errors").alias("code"))


# ---- provenance --------------------------------------------------------------


@query(f"""WITH {CLASSES}, p AS (SELECT event_id, user_id AS file, event_id % 100 AS line FROM events), b AS (SELECT o_custkey AS file, (o_orderkey % 4) * 25 AS a, (o_orderkey % 4) * 25 + 24 AS z, max(o_orderkey) AS commit_id FROM orders GROUP BY 1, 2, 3)
SELECT class, count(*) AS n, min(confidence) AS confidence FROM p JOIN b ON b.file = p.file AND line BETWEEN a AND z JOIN k USING (commit_id) GROUP BY 1""")
def suppression_debt_by_class(spark, d):
    """Each quarter of a file's hundred lines was last changed by the latest commit of those that touch it."""
    places = t(spark, d, "events").select(F.col("user_id").alias("file"), (F.col("event_id") % 100).alias("line"))
    at = F.col("o_orderkey") % 4 * 25
    blamed = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("file"), at.alias("from_line"), (at + 24).alias("to_line")).agg(F.max("o_orderkey").alias("commit_id"))
    return findings.by_blamed_class(places, blamed, classes(spark, d))


@query("""SELECT o_orderkey AS commit_id, 'd' || x AS name FROM (SELECT o_orderkey, unnest([o_custkey % 5, o_custkey % 7 + 3]) AS x, [o_orderkey % 4, o_orderkey % 6] AS before, o_orderkey % 9 AS seen FROM orders) WHERE NOT list_contains(before, x) AND x <> seen GROUP BY 1, 2""")
def dependencies_added_unreferenced(spark, d):
    dep = lambda *xs: F.array(*(F.concat(F.lit("d"), x) for x in xs))
    rows = t(spark, d, "orders").select(
        F.col("o_orderkey").alias("commit_id"),
        dep(F.col("o_orderkey") % 4, F.col("o_orderkey") % 6).alias("before"),
        dep(F.col("o_custkey") % 5, F.col("o_custkey") % 7 + 3).alias("after"),
        F.concat(F.lit("use d"), F.col("o_orderkey") % 9, F.lit(";")).alias("touched"),
    )
    return provenance.added_unreferenced(rows)


@query("""SELECT o_orderkey AS commit_id, CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 'contractor-x' WHEN contains(lower(c_mktsegment), 'build') THEN 'contractor-x'
WHEN contains(lower(o_orderstatus || '-ci'), 'f-ci') OR contains(lower(o_orderpriority), 'f-ci') THEN 'internal-bot' END AS label FROM orders JOIN customer ON c_custkey = o_custkey""")
def provenance_labels_by_place(spark, d):
    """The first configured label that a trailer or the author's address matches."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("author_email"))
    trailers = F.array("o_orderpriority", F.concat("o_orderstatus", F.lit("-CI")))
    commits = t(spark, d, "orders").join(c, "o_custkey").select(F.col("o_orderkey").alias("commit_id"), "author_email", trailers.alias("trailers"))
    labels = [(0, "contractor-x", "Urgent", "trailer"), (0, "contractor-x", "build", "email"), (1, "internal-bot", "f-ci", "trailer")]
    return provenance.labelled(commits, spark.createDataFrame(labels, "ord int, label string, needle string, place string"))


@query("""WITH e AS (SELECT p_brand AS crate, 'boolean-state-cluster|' || p_brand || '|' || array_to_string(list_sort(list(p_type)), ',') || '|' || array_to_string(list_sort(list(DISTINCT p_name)), ',') AS key FROM part GROUP BY 1)
SELECT crate, 'pattern:boolean-state-cluster:' || lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(strlen(key)), lambda i: ascii(substr(key, (i + 1)::BIGINT, 1))::HUGEINT)),
 lambda h, b: xor(h, b) * 1099511628211::HUGEINT % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS id FROM e""")
def pattern_candidate_ids(spark, d):
    """A stable id of each brand's evidence, whatever order the rows come in."""
    rows = t(spark, d, "part").groupBy(F.col("p_brand").alias("crate")).agg(F.collect_list("p_type").alias("modules"), F.collect_list("p_name").alias("evidence"))
    return rows.select("crate", names.candidate_id(F.lit("boolean-state-cluster"), F.col("crate"), F.col("modules"), F.col("evidence")).alias("id"))


_ITEMS = """i AS (SELECT o_custkey AS module, o_orderkey AS name, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 'macro' WHEN '5-LOW' THEN 'original' ELSE 're_export' END AS kind,
 lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS fst FROM orders)"""


@query(f"""WITH RECURSIVE {_ITEMS}, walk(use, name, hops, status) AS (SELECT name, coalesce(nxt, fst), 1, NULL::VARCHAR FROM i WHERE kind = 're_export'
UNION ALL SELECT use, CASE WHEN kind = 're_export' THEN coalesce(nxt, fst) ELSE w.name END, CASE WHEN kind = 're_export' THEN hops + 1 ELSE hops END,
 CASE WHEN kind = 'original' THEN 'original' WHEN kind = 'macro' THEN 'unclassified' END FROM walk w JOIN i ON i.name = w.name WHERE status IS NULL AND hops < 5),
last AS (SELECT use, max(hops) AS hops, max(status) AS status FROM walk GROUP BY 1)
SELECT use, CASE WHEN status = 'unclassified' THEN NULL ELSE hops END::INTEGER AS hops, coalesce(status, 'capped') AS status FROM last""")
def re_export_chains(spark, d):
    """An order re-exports its customer's next one, the last the first again, so that chains end, are cut, or go round."""
    from pyspark.sql import Window

    order = Window.partitionBy("module").orderBy("name")
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("name"), "o_orderpriority")
    kind = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "macro").when(F.col("o_orderpriority") == "5-LOW", "original").otherwise("re_export")
    items = o.select("module", "name", kind.alias("kind"), F.col("module").alias("to_module"), F.coalesce(F.lead("name").over(order), F.first("name").over(order)).alias("to_name"))
    uses = items.where("kind = 're_export'").select(F.col("name").alias("use"), F.col("to_module").alias("module"), F.col("to_name").alias("name"))
    return structure.re_export_chains(uses, items)
