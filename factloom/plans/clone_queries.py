"""Queries over clones: classes between documents in every mode, the ranges of a file that are left out, families.

Importing this module adds them to the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clones
from .catalogue import query, t


def documents(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query()
def clone_classes(spark, d):
    """Clones between documents at the reference's 20 tokens, a token being what white space separates, as classes with members."""
    return clones.clone_classes(documents(spark, d), "words")


@query()
def clone_classes_strict(spark, d):
    """By source tokens and what stands between them."""
    return clones.clone_classes(documents(spark, d), "strict")


@query()
def clone_classes_mild(spark, d):
    return clones.clone_classes(documents(spark, d), "mild")


@query()
def clone_classes_weak(spark, d):
    return clones.clone_classes(documents(spark, d), "weak")


@query()
def clone_classes_semantic(spark, d):
    return clones.clone_classes(documents(spark, d), "semantic")


PATTERN = r"[A-Za-zÀ-ÖØ-öø-ÿ_][A-Za-z0-9À-ÖØ-öø-ÿ_]*|[0-9]+|[^\sA-Za-z0-9À-ÖØ-öø-ÿ_]"
LEAST = 6


def turns(spark: SparkSession, d: str) -> DataFrame:
    """id, toks of every turn of a conversation, as if it were a function."""
    c = t(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("toks"))


def _classes_sql(mode: str) -> str:
    keep = """tok IN ('self', 'Self', 'crate', 'super') OR regexp_matches(tok, '^[A-ZÀ-ÖØ-Þ]') OR tok IN ('as', 'async', 'await', 'break', 'const', 'continue', 'dyn', 'else', 'enum', 'extern', 'fn', 'for', 'if', 'impl', 'in', 'let', 'loop', 'match', 'mod', 'move',
 'mut', 'pub', 'ref', 'return', 'static', 'struct', 'trait', 'type', 'unsafe', 'use', 'where', 'while', 'abstract', 'become', 'box', 'do', 'final', 'macro', 'override', 'priv', 'try', 'typeof', 'unsized', 'virtual', 'yield', 'union')
 OR coalesce(n1, '') IN ('(', '!') OR (n1 = ':' AND n2 = ':') OR coalesce(p1, '') = '.' OR (p1 = ':' AND p2 = ':')"""
    number = f"regexp_matches(tok, '^[A-Za-zÀ-ÖØ-öø-ÿ_]') AND tok NOT IN ('true', 'false') AND NOT coalesce({keep}, false)" if mode == "semantic" else "false"
    return f"""WITH f AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '{PATTERN}') AS k FROM conversations),
a AS (SELECT id, unnest(k) AS tok, unnest(range(len(k))) AS pos FROM f), b AS (SELECT *, lead(tok) OVER o AS n1, lead(tok, 2) OVER o AS n2, lag(tok) OVER o AS p1, lag(tok, 2) OVER o AS p2 FROM a WINDOW o AS (PARTITION BY id ORDER BY pos)),
c AS (SELECT *, {number} AS named FROM b), e AS (SELECT *, min(CASE WHEN named THEN pos END) OVER (PARTITION BY id, tok, named) AS born FROM c),
u AS (SELECT id, pos, CASE WHEN tok IN ('true', 'false') THEN '__BOOL_LIT__' WHEN regexp_matches(tok, '^[0-9]') THEN '__INT_LIT__' WHEN named THEN '__ID_' || (dense_rank() OVER (PARTITION BY id, named ORDER BY born) - 1) || '__' ELSE tok END AS unit FROM e),
s AS (SELECT id, list(unit ORDER BY pos) AS k FROM u GROUP BY id),
w AS MATERIALIZED (SELECT id, p - 1 AS pos, array_to_string(k[p : p + {LEAST} - 1], chr(1)) AS h FROM (SELECT id, k, unnest(generate_series(1, len(k) - {LEAST} + 1)) AS p FROM s WHERE len(k) >= {LEAST})),
n AS (SELECT h, count(*) AS n FROM w GROUP BY h HAVING count(DISTINCT id) > 1), v AS MATERIALIZED (SELECT id, pos, h, n FROM w JOIN n USING (h)),
g AS (SELECT x.h, y.h AS g, count(*) AS m FROM v x JOIN v y ON x.id = y.id AND y.pos = x.pos + 1 GROUP BY 1, 2),
l AS (SELECT v.*, lag(pos) OVER o AS lp, lag(h) OVER o AS lh, lag(n) OVER o AS ln FROM v WINDOW o AS (PARTITION BY id ORDER BY pos)),
r AS (SELECT l.*, sum(CASE WHEN lp = pos - 1 AND m = n AND m = ln THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS part FROM l LEFT JOIN g ON g.h = lh AND g.g = l.h AND lp = pos - 1),
q AS (SELECT id, min(pos) AS start, count(*) + {LEAST} - 1 AS length, arg_min(h, pos) AS class FROM r GROUP BY id, part),
z AS (SELECT *, min((id, start)) OVER (PARTITION BY class) AS f FROM q)
SELECT f[1] AS first_id, f[2]::INTEGER AS first_start, id, start::INTEGER AS start, length::INTEGER AS length FROM z"""


@query(_classes_sql("mild"))
def clone_turns_mild(spark, d):
    return clones.named_by_first(clones.clone_classes(turns(spark, d), "mild", LEAST))


@query(_classes_sql("weak"))
def clone_turns_weak(spark, d):
    return clones.named_by_first(clones.clone_classes(turns(spark, d), "weak", LEAST))


@query(_classes_sql("semantic"))
def clone_turns_semantic(spark, d):
    return clones.named_by_first(clones.clone_classes(turns(spark, d), "semantic", LEAST))


# ---- ranges that are left out ------------------------------------------------

OFF, ON = "// clones-off:", "// clones-on"


def marked_lines(spark: SparkSession, d: str) -> DataFrame:
    """file, line, text: an order's items as a file's lines, whose flag is a marker or none."""
    li = t(spark, d, "lineitem")
    mark = F.when(F.col("l_returnflag") == "R", F.concat(F.lit(OFF), F.when(F.col("l_quantity") < 2, "  ").otherwise(" vendored"))).when(F.col("l_returnflag") == "A", ON).otherwise("code();")
    return li.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"), mark.alias("text")).groupBy("file", "line").agg(F.min("text").alias("text"))


EVENTS = """lines AS (SELECT l_orderkey AS file, l_linenumber::INTEGER AS line, min(CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity < 2 THEN '// clones-off:  ' ELSE '// clones-off: vendored' END WHEN 'A' THEN '// clones-on' ELSE 'code();' END) AS text FROM lineitem GROUP BY 1, 2),
 ev AS (SELECT file, line, CASE WHEN contains(text, '// clones-off:') THEN 'off' ELSE 'on' END AS kind, trim(substr(text, 15)) = '' AND contains(text, '// clones-off:') AS bad FROM lines WHERE contains(text, '// clones-')),
 bad AS (SELECT file, line FROM ev WHERE bad)"""


@query(f"""WITH RECURSIVE {EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS i FROM ev WHERE file NOT IN (SELECT file FROM bad)),
walk(file, i, open_, start, "end") AS (SELECT DISTINCT file, 0::BIGINT, NULL::INTEGER, NULL::INTEGER, NULL::INTEGER FROM n
 UNION ALL SELECT n.file, n.i, CASE WHEN kind = 'off' THEN coalesce(open_, line) END, CASE WHEN kind = 'on' THEN open_ END, CASE WHEN kind = 'on' AND open_ IS NOT NULL THEN line END FROM walk w JOIN n ON n.file = w.file AND n.i = w.i + 1)
SELECT file, start, "end" FROM walk WHERE "end" IS NOT NULL
UNION ALL SELECT file, open_, 2147483647 FROM (SELECT *, max(i) OVER (PARTITION BY file) AS m FROM walk) WHERE i = m AND open_ IS NOT NULL""")
def off_ranges(spark, d):
    """The machine of two states, which the SQL walks event by event."""
    return clones.off_ranges(clones.marker_events(marked_lines(spark, d), OFF, ON))[0]


@query(f"WITH {EVENTS} SELECT file, line FROM bad")
def off_without_reason(spark, d):
    return clones.off_ranges(clones.marker_events(marked_lines(spark, d), OFF, ON))[1]


def turn_ranges(spark: SparkSession, d: str) -> DataFrame:
    """file, start, end: of every fifth turn the first two lines, of every seventh all from the third on. A turn is a file, four tokens a line."""
    ids = turns(spark, d).select(F.col("id").alias("file"))
    return ids.where("file % 5 = 0").select("file", F.lit(1).alias("start"), F.lit(2).alias("end")).unionByName(ids.where("file % 7 = 0").select("file", F.lit(3).alias("start"), F.lit(clones.OPEN_END).alias("end")))


FAMILIES = f"""f AS (SELECT conv_id * 1000 + turn AS id, regexp_extract_all(text, '{PATTERN}') AS k FROM conversations),
 w AS (SELECT id, p - 1 AS pos, array_to_string(k[p : p + 5], chr(1)) AS h FROM (SELECT id, k, unnest(generate_series(1, len(k) - 5)) AS p FROM f WHERE len(k) >= 6)),
 m AS (SELECT a.id AS a, b.id AS b, a.pos AS pa, b.pos - a.pos AS d FROM w a JOIN w b ON a.h = b.h AND a.id < b.id), i AS (SELECT *, pa - row_number() OVER (PARTITION BY a, b, d ORDER BY pa) AS k FROM m),
 p AS (SELECT a, b, min(pa) AS x, min(pa) + d AS y, max(pa) - min(pa) + 6 AS n FROM i GROUP BY a, b, d, k),
 r AS (SELECT id AS file, 1 AS s, 2 AS e FROM f WHERE id % 5 = 0 UNION ALL SELECT id, 3, 2147483647 FROM f WHERE id % 7 = 0),
 o AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE file = a AND s <= x // 4 + 1 AND (x + n - 1) // 4 + 1 <= e) AND NOT EXISTS (SELECT 1 FROM r WHERE file = b AND s <= y // 4 + 1 AND (y + n - 1) // 4 + 1 <= e)),
 s AS (SELECT a AS id, x AS start, n FROM o UNION SELECT b, y, n FROM o),
 t AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s z WHERE z.id = s.id AND z.start <= s.start AND z.start + z.n >= s.start + s.n AND z.n > s.n)),
 c AS (SELECT t.id, t.start, t.n, array_to_string(k[start + 1 : start + n], chr(1)) AS content FROM t JOIN f USING (id)),
 fam AS (SELECT sha256(content) AS family, id, start::INTEGER AS start, n::INTEGER AS length, count(*) OVER (PARTITION BY content) AS members FROM c)"""


def found_families(spark: SparkSession, d: str) -> DataFrame:
    rows = turns(spark, d)
    lines = F.transform(F.sequence(F.lit(1), F.size("toks")), lambda i: ((i - 1) / 4).cast("int") + 1)
    places = rows.where(F.size("toks") > 0).select("id", F.col("id").alias("file"), lines.alias("lines"))
    return clones.families_of_texts(rows, places, turn_ranges(spark, d), LEAST)


@query(f"WITH {FAMILIES} SELECT * FROM fam WHERE members > 1")
def clone_families_outside_ranges(spark, d):
    """Families between turns, without pairs of which one lies wholly in a range that is left out."""
    return found_families(spark, d)


@query(f"WITH {FAMILIES}, x AS (SELECT DISTINCT family, members FROM fam WHERE members > 1) SELECT family, members, (row_number() OVER (ORDER BY members DESC, family))::INTEGER AS rank FROM x QUALIFY rank <= 15")
def largest_clone_families(spark, d):
    return clones.largest_families(found_families(spark, d))


@query(f"WITH {FAMILIES} SELECT coalesce(sum(length), 0)::BIGINT AS tokens FROM fam WHERE members > 1")
def duplicated_tokens(spark, d):
    return clones.duplicated_tokens(found_families(spark, d))
