"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .importance import BUCKETS, LEAST_WORDS, SEED, SHARE
from .url_templates import DEPTH, RULES


def _crc_table() -> list[int]:
    """CRC-32 of each four bits, by its polynomial."""
    out = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a SQL text's UTF-8 bytes, four bits a step, the lower ones of a byte first. The text must be no lambda's."""
    nibble = f"instr('0123456789ABCDEF', substr(hex({text}), (CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END)::BIGINT, 1)) - 1"
    step = f"xor(c >> 4, (CAST({_crc_table()} AS BIGINT[]))[(xor(c, x) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({text}) * 2), lambda k: ({nibble})::BIGINT)), lambda c, x: {step}), 4294967295::BIGINT)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
dw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) GROUP BY w),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY w),
named AS (SELECT w, {crc32("w")} % {BUCKETS} AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM dw JOIN named USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM bw JOIN named USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM s) AS S, (SELECT coalesce(sum(n), 0)::BIGINT FROM t) AS T),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1) * (S + {BUCKETS}))::DOUBLE / ((coalesce(s.n, 0) + 1) * (T + {BUCKETS}))::DOUBLE))::BIGINT AS gain
         FROM (SELECT unnest(range({BUCKETS})) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
word AS (SELECT w, gain FROM named JOIN gain USING (bucket)),
one AS (SELECT doc_id, unnest(ws) AS w FROM d),
weighed AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM one JOIN word USING (w) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256(concat('{SEED}:', doc_id)), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM documents LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT scored.*, CASE WHEN r <= {SHARE} * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
"""

_RUNS = "regexp_extract_all(" + _LOWER.format("text") + ", '[A-Za-zÀ-ÿ]+')"

OP13 = f"""
WITH RECURSIVE runs AS (SELECT doc_id, r, count(*) AS k FROM (SELECT doc_id, unnest({_RUNS}) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT r, k, {crc32("t")} AS h FROM (SELECT r, k, concat(doc_id, ':', r) AS t FROM runs)),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN concat(left(r, h % length(r)), substr(r, h % length(r) + 2)) ELSE r END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM cut GROUP BY word HAVING sum(k) >= 3 AND length(word) >= 5),
without AS MATERIALIZED (SELECT word, i, concat(left(word, i), substr(word, i + 2)) AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT a.word, b.word AS other FROM without a JOIN without b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
         UNION SELECT a.word, w.word FROM without a JOIN words w ON a.v = w.word
         UNION SELECT w.word, a.word FROM without a JOIN words w ON a.v = w.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top, min(other) FILTER (n = most) AS form
         FROM (SELECT near.word, other, words.n, max(words.n) OVER (PARTITION BY near.word) AS most FROM near JOIN words ON other = words.word) GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN form END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def _op12(depth: int = DEPTH) -> str:
    """The same tree, a chain of levels."""
    smooth = "({} + 8.0::DOUBLE * {}) / ({} + 8.0::DOUBLE)"
    rest = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    parts = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '#', 'g'), '/')"
    out = f"""
WITH cut AS (SELECT page_id, url, {rest} AS rest FROM pages),
split AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
parsed AS MATERIALIZED (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM split),
rows0 AS MATERIALIZED (SELECT page_id, url, host, path, CASE WHEN path = '' THEN [] WHEN len(p) > {depth} THEN list_append(p[1:{depth - 1}], array_to_string(p[{depth}:], '/')) ELSE p END AS segs FROM (SELECT *, {parts} AS p FROM parsed)),
marks AS (SELECT host, segs, quality AS good FROM rows0 JOIN labels ON try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1), '') AS BIGINT) = doc_id WHERE quality IS NOT NULL),
paths AS (SELECT host, segs, sum(n) AS n, sum(l) AS l, sum(g) AS g FROM (SELECT host, segs, count(*) AS n, 0 AS l, 0 AS g FROM rows0 GROUP BY ALL UNION ALL SELECT host, segs, 0, count(*), sum(good) FROM marks GROUP BY ALL) GROUP BY ALL),
whole AS (SELECT (sum(g) + 1)::DOUBLE / (sum(l) + 2)::DOUBLE AS w FROM paths),
hosts AS (SELECT host, {smooth.format("sum(g)", "any_value(w)", "sum(l)")} AS purity FROM paths, whole GROUP BY host),
t0 AS MATERIALIZED (SELECT paths.*, purity, '' AS template FROM paths JOIN hosts USING (host))"""
    for k in range(1, depth + 1):
        out += f""",
s{k} AS (SELECT *, segs[{k}] AS seg FROM t{k - 1}),
c{k} AS (SELECT host, template, seg, any_value(purity) AS parent, sum(n) AS n, sum(l) AS l, sum(g) AS g, sum(CASE WHEN len(segs) = {k} THEN n ELSE 0 END) AS e FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
k{k} AS (SELECT *, {smooth.format("g", "parent", "l")} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS pages FROM c{k}) WHERE n >= 4 AND n * 100 >= pages),
v{k} AS (SELECT *, p * (1 - p) / (l + 8.0::DOUBLE) AS v, e::DOUBLE / n::DOUBLE AS ended FROM k{k}),
g{k} AS (SELECT *, lag(p) OVER o AS pb, lag(v) OVER o AS vb, lag(ended) OVER o AS eb FROM v{k} WINDOW o AS (PARTITION BY host, template ORDER BY p, seg)),
b{k} AS (SELECT *, sum(CASE WHEN pb IS NULL OR (p - pb) * (p - pb) > 3.84::DOUBLE * (v + vb) OR abs(ended - eb) > 0.25::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY p, seg) AS b FROM g{k}),
m{k} AS (SELECT host, template, b, string_agg(seg, '|' ORDER BY seg) AS branch, {smooth.format("sum(g)", "any_value(parent)", "sum(l)")} AS bp FROM b{k} GROUP BY ALL),
j{k} AS (SELECT s.host, s.segs, s.n, s.l, s.g, s.purity, s.template, bp, CASE WHEN s.seg IS NOT NULL THEN coalesce(branch, '*') END AS branch
         FROM s{k} s LEFT JOIN b{k} b ON s.host = b.host AND s.template = b.template AND s.seg = b.seg LEFT JOIN m{k} m ON b.host = m.host AND b.template = m.template AND b.b = m.b),
x{k} AS (SELECT *, sum(CASE WHEN branch = '*' THEN l ELSE 0 END) OVER (PARTITION BY host, template) AS sl, sum(CASE WHEN branch = '*' THEN g ELSE 0 END) OVER (PARTITION BY host, template) AS sg FROM j{k}),
t{k} AS MATERIALIZED (SELECT host, segs, n, l, g, CASE WHEN branch IS NULL THEN purity WHEN branch = '*' THEN {smooth.format("sg", "purity", "sl")} ELSE bp END AS purity, CASE WHEN branch IS NULL THEN template ELSE concat(template, '/', branch) END AS template FROM x{k})"""
    rules = sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2]), reverse=True)
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{v}-{h}{p}}}" for v, h, p in rules)

    def case(what: int) -> str:
        out = f"CASE {fits} END"
        for v, h, p in rules:
            out = out.replace(f"{{{v}-{h}{p}}}", f"'{v if what else h + p}'")
        return out

    return out + f"""
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM rows0 JOIN t{depth} USING (host, segs)"""


OP12 = _op12()
