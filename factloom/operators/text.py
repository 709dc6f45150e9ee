"""Text signals: entropy, secrets, phrases, restating lines, step chains, name collisions, clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import family, normalised

#: How many tokens after a window of clone_spans() travel with it: of 717,406 spans of 5 words or more between the turns of check_s, 6,643 have 2 or more.
AHEAD = 2
#: Known secret formats, over the whole value; first match wins.
SECRETS = (
    ("aws_access_key_id", r"\AAKIA[A-Z0-9]{16}\z"),
    ("github_token", r"\A(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36}\z"),
    ("slack_token", r"(?s)\A(?:xoxb-|xoxp-|xoxa-|xoxr-|xoxs-).{15,}\z"),
    ("google_api_key", r"\AAIza[A-Za-z0-9_-]{35}\z"),
    ("pem_private_key", r"(?s)\A(?=.*-----BEGIN)(?=.*PRIVATE KEY-----)"),
)
#: Parts of names that hint at a secret.
SUSPICIOUS = (
    "secret",
    "password",
    "passwd",
    "token",
    "apikey",
    "api_key",
    "access_key",
    "private_key",
    "client_secret",
    "auth_token",
    "credential",
)


def entropy(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, entropy: Shannon entropy in bits of a string's characters."""
    chars = rows.select(key, F.explode(F.filter(F.split(F.col(value), ""), lambda c: c != "")).alias("c"))
    counts = chars.groupBy(key, "c").agg(F.count("*").alias("n"))
    sums = counts.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(key, F.round(F.log2("t") - F.col("s") / F.col("t"), 6).alias("entropy"))


def secret_kind(value: str) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SECRETS):
        out = F.when(F.col(value).rlike(pattern), name).otherwise(out)
    return out


def normal_words(name: str) -> Column:
    """camelCase and snake-case as _words_."""
    split = F.lower(F.regexp_replace(F.col(name), "([a-z0-9])([A-Z])", "$1_$2"))
    return F.concat(F.lit("_"), F.regexp_replace(F.regexp_replace(split, "-", "_"), "_+", "_"), F.lit("_"))


def secrets(assignments: DataFrame, length: int = 16, bits: float = 3.5) -> DataFrame:
    """Of rows (id, name, value) those that match a known format, or whose name is suspicious and value long and random."""
    e = entropy(assignments, "id", "value")
    rows = assignments.join(e, "id", "left").withColumn("kind", secret_kind("value"))
    named = normal_words("name").rlike("_(" + "|".join(SUSPICIOUS) + ")_")
    lane = F.when(F.col("kind").isNotNull(), F.col("kind")).when(named & (F.octet_length("value") >= length) & (F.col("entropy") >= bits), "entropy")
    return rows.withColumn("lane", lane).where("lane is not null").select("id", "name", "lane", "entropy")


def tokens(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase_hits(rows: DataFrame, text: str, phrases: DataFrame) -> DataFrame:
    """rows x phrases (phrase, tier) that occur between word boundaries. phrases is a configuration of bounded size."""
    low = F.lower(F.col(text))
    pattern = F.concat(F.lit(r"(^|[^\p{L}\p{N}])"), F.col("phrase"), F.lit(r"($|[^\p{L}\p{N}])"))
    return rows.crossJoin(F.broadcast(phrases)).where(F.regexp_like(low, pattern))


def restating_pairs(lines: DataFrame, similarity: float = 0.7, left: int = 4, right: int = 3) -> DataFrame:
    """Lines (doc, line, text) that say what the next non-blank one says: Jaccard of token sets with floors on both sizes."""
    order = Window.partitionBy("doc").orderBy("line")
    sets = lines.withColumn("a", F.array_distinct(tokens("text")))
    pairs = sets.withColumn("b", F.lead("a").over(order)).where(F.col("b").isNotNull() & (F.size("a") >= left) & (F.size("b") >= right))
    j = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return pairs.withColumn("jaccard", F.round(j, 6)).where(F.col("jaccard") >= similarity).select("doc", "line", "jaccard")


def step_chains(steps: DataFrame, lines: DataFrame, least: int = 3, apart: int = 2) -> DataFrame:
    """file, item, first_line, length, lines of runs of numbered step comments: each number one more than the one before in the file, within one item, with
    `apart` non-blank lines between them at most.

    steps: file, line, number, item (null: none), the comments that aren't documentation and have a number, in their order in the file. lines: file, line, text. How many
    non-blank lines lie between two comments is a difference of two counts up to a line.
    """
    so_far = Window.partitionBy("file").orderBy("line")
    filled = F.when(F.trim("text") != "", 1).otherwise(0)
    counted = lines.withColumn("filled", filled).withColumn("up_to", F.sum("filled").over(so_far)).select("file", "line", "up_to", (F.col("up_to") - F.col("filled")).alias("before"))
    order = Window.partitionBy("file").orderBy("line", "number")
    placed = steps.join(counted, ["file", "line"], "left")
    between = F.greatest(F.col("before") - F.lag("up_to").over(order), F.lit(0))
    same = F.lag("item").over(order).eqNullSafe(F.col("item")) & (F.col("number") == F.lag("number").over(order) + 1) & (between <= apart)
    runs = placed.withColumn("begins", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order))
    found = runs.groupBy("file", "run").agg(F.first("item").alias("item"), F.array_sort(F.collect_list("line")).alias("lines"))
    return found.where(F.size("lines") >= least).select("file", "item", F.get("lines", F.lit(0)).alias("first_line"), F.size("lines").alias("length"), "lines")


def near_names(names: DataFrame, popular: DataFrame, least: int = 6) -> DataFrame:
    """name, nearest: declared names of `least` bytes or more at edit distance 1 of a popular one, as names.normalised() has them; names of one family
    (equal, or one is the other and an underscore with more) are left out. Of several popular names the first counts, by their column ord or by name.

    Two names at distance 1 share their text with one character left out, so the join is on those variants instead of all pairs.
    """
    order = "ord" if "ord" in popular.columns else "name"

    def variants(df: DataFrame, column: str) -> DataFrame:
        c = F.col(column)
        cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return df.where(F.length(c) > 0).select("*", F.explode(F.array_distinct(F.array_append(cut, c))).alias("v"))

    a = variants(names.where(F.octet_length("name") >= least).select("name", normalised("name").alias("n")).distinct(), "n")
    b = variants(popular.select(F.col("name").alias("nearest"), normalised("name").alias("m"), F.col(order).alias("ord")).distinct(), "m")
    pairs = a.join(b, "v").select("name", "nearest", "n", "m", "ord").distinct().where(F.levenshtein("n", "m") == 1)
    return pairs.where(~family("n", "m")).groupBy("name").agg(F.min_by("nearest", "ord").alias("nearest"))


def clone_spans(token_rows: DataFrame, least: int = 20) -> DataFrame:
    """Maximal common token spans of different functions: rows (id, toks array) to (a, b, a_from, b_from, length).

    Windows of `least` tokens meet by 128 bits of their text, and bring 64-bit hashes of the token before and of the AHEAD next ones. A match begins a span if the tokens before differ, and its length
    shows in the next ones: such a span is a row where its windows meet, and no other match is sent anywhere. Of longer spans the first and the last match meet by their diagonal.
    """
    texts = token_rows.where(F.size("toks") >= least).select("id", "toks", F.transform("toks", lambda x: F.xxhash64(x)).alias("units"))
    unit = lambda i: F.get("units", i)

    def window(p: Column) -> Column:
        h = F.unhex(F.md5(F.array_join(F.slice("toks", p + 1, least), "\u0001")))
        back = F.when(p >= AHEAD, F.xxhash64(*(unit(p - k - 1) for k in range(AHEAD))))
        return F.struct(p.alias("pos"), h.alias("h"), unit(p - 1).alias("left"), back.alias("back"), *(unit(p + least + k).alias(f"r{k}") for k in range(AHEAD)))

    w = texts.select("id", F.inline(F.transform(F.sequence(F.lit(0), F.size("toks") - least), window)))
    a, b = (w.select(*(F.col(c).alias(c if c == "h" else f"{side}_{c}") for c in w.columns)) for side in "ab")
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    more = F.lit(AHEAD)  # how many of the next tokens agree
    for k in reversed(range(AHEAD)):
        more = F.when(~same(f"r{k}"), k).otherwise(more)
    hits = a.join(b, "h").where("a_id < b_id").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("a_pos").alias("a_from"), F.col("b_pos").alias("b_from"), (~same("left")).alias("begins"), same("back").alias("long"), more.alias("more"))
    # a match that begins a span is never long; asked for, it leaves both parts the same columns, and so the same shuffle
    short = hits.where(F.col("begins") & ~F.col("long") & (F.col("more") < AHEAD)).select("a", "b", "a_from", "b_from", (F.col("more") + least).alias("length"))
    first, last = F.col("begins") & (F.col("more") == AHEAD), ~F.col("begins") & F.col("long") & (F.col("more") == 0)
    order = Window.partitionBy("a", "b", F.col("b_from") - F.col("a_from")).orderBy("a_from")
    ends = hits.where(first | last).withColumn("last", F.lead("a_from").over(order)).where("begins")
    return short.unionByName(ends.select("a", "b", "a_from", "b_from", (F.col("last") - F.col("a_from") + least).alias("length")))


def clone_families(token_rows: DataFrame, least: int = 20) -> DataFrame:
    """family, id, start, length, members: equal maximal spans of clone_spans() as one family, of two members or more.

    A member within a larger span of the same function is dropped first, and families left with one member go with it.
    """
    s = clone_spans(token_rows, least)
    spans = s.select(F.col("a").alias("id"), F.col("a_from").alias("start"), "length").union(s.select("b", "b_from", "length")).distinct()
    o = spans.select(F.col("id").alias("oid"), F.col("start").alias("ostart"), F.col("length").alias("olength"))
    within = (F.col("id") == F.col("oid")) & (F.col("start") >= F.col("ostart")) & (F.col("start") + F.col("length") <= F.col("ostart") + F.col("olength")) & (F.col("length") < F.col("olength"))
    kept = spans.join(o, within, "left_anti").join(token_rows, "id")
    named = kept.select(F.sha2(F.array_join(F.slice("toks", F.col("start") + 1, F.col("length")), "\u0001"), 256).alias("family"), "id", "start", "length")
    sizes = named.groupBy("family").agg(F.count("*").alias("members")).where("members > 1")
    return named.join(sizes, "family")


def isolated_families(families: DataFrame, fan_in: DataFrame) -> DataFrame:
    """family of those whose every member has fan_in (id, references) of 0; a member without a row is not isolated."""
    rows = families.join(fan_in, "id", "left")
    return rows.groupBy("family").agg(F.bool_and(F.coalesce(F.col("references") == 0, F.lit(False))).alias("alone")).where("alone").select("family")
