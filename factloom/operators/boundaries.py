"""Boundary rules between groups of packages and between modules.

A rule table has a row for each pair: name, src, dst, kind (forbidden or required), reach (direct or transitive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources.shared import Stored
from .graphs import shortest_paths

#: The roles of the hexagonal preset.
ROLES = ("core", "ports", "adapters")

#: The roles of the hexagonal preset.
ROLES = ("core", "ports", "adapters")


def violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, src, dst, path: forbidden pairs that an edge or, if the rule reaches further, the shortest path joins; and with dst null, sources
    that reach none of the targets that their rule requires."""
    e = Stored(edges.select("src", "dst").distinct()).frame
    far = shortest_paths(e, rules.where("reach = 'transitive'").select(F.col("src").alias("node")).distinct()).select(F.col("start").alias("src"), F.col("node").alias("dst"), F.col("path").cast("array<string>").alias("path"))
    near = e.select("src", "dst", F.array("src", "dst").cast("array<string>").alias("path"))
    met = rules.where("reach = 'direct'").join(near, ["src", "dst"]).unionByName(rules.where("reach = 'transitive'").join(far, ["src", "dst"]))
    forbidden = met.where("kind = 'forbidden'").select(F.col("name").alias("rule"), "src", "dst", F.array_join("path", ">").alias("path"))
    required = rules.where("kind = 'required'").select("name", "src").distinct()
    missing = required.join(met.where("kind = 'required'").select("name", "src"), ["name", "src"], "left_anti")
    return forbidden.unionByName(missing.select(F.col("name").alias("rule"), "src", F.lit(None).cast(dict(rules.dtypes)["dst"]).alias("dst"), F.lit(None).cast("string").alias("path")))


def _pairs(assigned: DataFrame, name: str) -> DataFrame:
    """(src, sg, dst, dg): all pairs of nodes of different groups; assigned (node, grp) is a configuration, and rules say as much."""
    a, b = assigned.select(F.col("node").alias("src"), F.col("grp").alias("sg")), assigned.select(F.col("node").alias("dst"), F.col("grp").alias("dg"))
    return a.join(b, F.col("sg") != F.col("dg")).withColumn("name", F.concat(F.lit(f"preset:{name}:"), F.col("sg").cast("string")))


def layered(assigned: DataFrame, order: list) -> DataFrame:
    """Rules of the layered preset: no layer reaches a later one of the order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("grp"))
    ranked = assigned.select("node", "grp", place.alias("p"))
    pairs = _pairs(assigned, "layered").join(ranked.select(F.col("node").alias("src"), F.col("p").alias("sp")), "src").join(ranked.select(F.col("node").alias("dst"), F.col("p").alias("dp")), "dst")
    return pairs.where("sp > 0 and sp < dp").select("name", "src", "dst", F.lit("forbidden").alias("kind"), F.lit("transitive").alias("reach"))


def hexagonal(assigned: DataFrame) -> DataFrame:
    """Rules of the hexagonal preset: core and adapters don't touch each other, and adapters touch ports.

    An error for a role that isn't one of ROLES, and for one that no node has; assigned is a configuration, of which at most four roles come to the driver.
    """
    roles = {r[0] for r in assigned.select("grp").distinct().orderBy(F.col("grp").isin(*ROLES), "grp").limit(len(ROLES) + 1).collect()}
    if unknown := sorted(map(str, roles - set(ROLES))):
        raise ValueError(f"the hexagonal preset knows the roles {', '.join(ROLES)}, not {', '.join(unknown)}")
    if missing := [r for r in ROLES if r not in roles]:
        raise ValueError(f"the hexagonal preset needs a node of each role; none is of {', '.join(missing)}")
    pairs = _pairs(assigned, "hexagonal")
    kind = F.when((F.col("sg") == "core") & (F.col("dg") == "adapters"), "forbidden").when((F.col("sg") == "adapters") & (F.col("dg") == "core"), "forbidden").when((F.col("sg") == "adapters") & (F.col("dg") == "ports"), "required")
    return pairs.withColumn("kind", kind).where("kind is not null").select("name", "src", "dst", "kind", F.lit("direct").alias("reach"))


def feature_sliced(assigned: DataFrame, shared: str | None) -> DataFrame:
    """Rules of the feature-sliced preset: groups but the shared one don't reach each other."""
    pairs = _pairs(assigned if shared is None else assigned.where(F.col("grp") != shared), "feature-sliced")
    return pairs.select("name", "src", "dst", F.lit("forbidden").alias("kind"), F.lit("transitive").alias("reach"))


def module_violations(references: DataFrame, rules: DataFrame) -> DataFrame:
    """rule, file, line, forbidden: the earliest line of each file below a rule's module that refers to a module forbidden to it.

    references: file, module (of the file), line, segments (as written). rules: name, below, forbidden (module paths), a configuration of bounded size.
    """
    r = references.withColumn("to", names.resolved_segments("module", "segments")).where("to is not null")
    asked = rules.withColumn("parts", F.split("forbidden", "::"))
    hit = r.join(F.broadcast(asked), names.under_module("module", "below") & names.begins_with("to", "parts"))
    least = hit.groupBy(F.col("name").alias("rule"), "file").agg(F.min(F.struct("line", "forbidden")).alias("m"))
    return least.select("rule", "file", "m.line", "m.forbidden")
