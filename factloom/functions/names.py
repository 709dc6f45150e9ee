"""Scalar functions over names, paths, versions and comment texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name nothing.
GENERIC_WORDS = ("data", "result", "temp", "handler", "manager", "processor", "helper", "utils")
#: Words that a comment and the code below it share without saying the same.
STOPWORDS = ("the", "a", "an", "to", "of", "and", "this", "is", "let", "mut", "fn", "if", "else", "return")
#: The language's keywords, strict and reserved.
KEYWORDS = (
    "as", "async", "await", "break", "const", "continue", "dyn", "else", "enum", "extern", "fn",
    "for", "if", "impl", "in", "let", "loop", "match", "mod", "move", "mut", "pub", "ref",
    "return", "static", "struct", "trait", "type", "unsafe", "use", "where", "while", "abstract",
    "become", "box", "do", "final", "macro", "override", "priv", "try", "typeof", "unsized",
    "virtual", "yield", "union",
)
#: What stands for a literal of each kind in a normalised token stream.
LITERALS = {
    "str": "__STR_LIT__",
    "bytestr": "__BYTESTR_LIT__",
    "byte": "__BYTE_LIT__",
    "char": "__CHAR_LIT__",
    "int": "__INT_LIT__",
    "float": "__FLOAT_LIT__",
    "verbatim": "__LIT__",
    "bool": "__BOOL_LIT__",
}


def normalised(name: str) -> Column:
    """Lower case, - as _."""
    return F.translate(F.lower(F.col(name)), "-", "_")


def family(a: str, b: str) -> Column:
    """Whether two normalised names are equal or one is the other with _ and more."""
    x, y = F.col(a), F.col(b)
    return (x == y) | F.startswith(x, F.concat(y, F.lit("_"))) | F.startswith(y, F.concat(x, F.lit("_")))


def without_trailing_digits(name: str) -> Column:
    return F.regexp_replace(F.col(name), "[0-9]+$", "")


def is_generic(word: str) -> Column:
    return F.lower(F.col(word)).isin(*GENERIC_WORDS)


def is_keyword(word: str) -> Column:
    return F.col(word).isin(*KEYWORDS)


def literal_placeholder(kind: str) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in LITERALS.items() for x in kv)), F.col(kind))


def content_words(words: Column) -> Column:
    """The distinct words of an array that aren't stop words."""
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))


def step_number(text: str) -> Column:
    """The number of a text that begins with "step" and digits, whatever its case; null otherwise."""
    return F.expr(f"try_cast(nullif(regexp_extract({text}, '(?i)^\\\\s*step\\\\s*([0-9]+)', 1), '') as int)")


def unused_name(message: str) -> Column:
    """The name in back quotes of a lint message that says it is unused; null for other messages."""
    name = F.regexp_extract(F.col(message), "`([^`]*)`", 1)
    return F.when(F.col(message).contains("is unused in crate") & F.col(message).contains("`"), name)


def index_path(name: str) -> Column:
    """Where a sparse registry index keeps a name."""
    low = F.lower(F.col(name))
    n = F.length(low)
    return (
        F.when(n <= 1, F.concat(F.lit("1/"), low))
        .when(n == 2, F.concat(F.lit("2/"), low))
        .when(n == 3, F.concat(F.lit("3/"), F.substring(low, 1, 1), F.lit("/"), low))
        .otherwise(F.concat(F.substring(low, 1, 2), F.lit("/"), F.substring(low, 3, 2), F.lit("/"), low))
    )


def module_path(path: str) -> Column:
    """The module of a source file by its path below its package: "" for a root, null outside src or for other files."""
    p = F.col(path)
    rest = F.regexp_replace(p, "^src/", "")
    stem = F.regexp_replace(F.regexp_replace(rest, "(^|/)mod\\.rs$", ""), "\\.rs$", "")
    inner = F.translate(stem, "/", "\u0001")
    return (
        F.when(~p.startswith("src/"), None)
        .when(rest.isin("lib.rs", "main.rs") | rest.startswith("bin/"), "")
        .when(~rest.endswith(".rs"), None)
        .otherwise(F.replace(inner, F.lit("\u0001"), F.lit("::")))
    )


def joined_module(parent: str, name: str) -> Column:
    return F.when(F.col(parent) == "", F.col(name)).otherwise(F.concat_ws("::", parent, name))


def module_segments(path: str) -> Column:
    return F.when(F.col(path) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(path), "::"))


def under_module(path: str, prefix: str) -> Column:
    """Whether a module is another one or within it, by whole segments."""
    return (F.col(path) == F.col(prefix)) | F.startswith(path, F.concat(F.col(prefix), F.lit("::")))


def resolved_segments(module: str, segments: str) -> Column:
    """A path as segments below the package's root: only those that begin with crate or super can be told, others are null."""
    s, here = F.col(segments), module_segments(module)
    ups = F.size(F.filter(F.transform(s, lambda x, i: (x == "super") & F.forall(F.slice(s, 1, i + 1), lambda y: y == "super")), lambda x: x))
    rest = F.slice(s, ups + 1, F.size(s))
    above = F.concat(F.slice(here, F.lit(1), F.greatest(F.size(here) - ups, F.lit(0))), rest)
    return F.when(F.get(s, F.lit(0)) == "crate", F.slice(s, F.lit(2), F.size(s))).when((ups > 0) & (F.size(here) >= ups), above)


def begins_with(segments: str, prefix: str) -> Column:
    return F.slice(F.col(segments), F.lit(1), F.size(prefix)) == F.col(prefix)


def version(text: str) -> Column:
    """struct(major, minor, patch) of a version of two or three whole numbers, a missing patch as 0; null if it is none."""
    parts = F.split(F.regexp_replace(F.col(text), "[-+].*$", ""), "\\.")
    n = [F.expr(f"try_cast(get(split(regexp_replace({text}, '[-+].*$', ''), '[.]'), {i}) as int)") for i in range(3)]
    good = F.size(parts).isin(2, 3) & n[0].isNotNull() & n[1].isNotNull() & ((F.size(parts) == 2) | n[2].isNotNull())
    return F.when(good, F.struct(n[0].alias("major"), n[1].alias("minor"), F.coalesce(n[2], F.lit(0)).alias("patch")))


def compatible_with(v: str) -> Column:
    """The compatibility bucket of a version struct: its first number that isn't 0 with what stands before it."""
    major, minor, patch = (F.col(f"{v}.{c}") for c in ("major", "minor", "patch"))
    zero = F.lit(0)
    bucket = lambda *n: F.struct(*(x.alias(name) for x, name in zip(n, ("major", "minor", "patch"), strict=True)))
    return F.when(major > 0, bucket(major, zero, zero)).when(minor > 0, bucket(zero, minor, zero)).otherwise(bucket(zero, zero, patch))


def seconds_of(stamp: str) -> Column:
    """Seconds since 1970 of an RFC 3339 stamp's first 19 characters, without its zone; null if it is shorter or no date."""
    return F.when(F.length(stamp) >= 19, F.unix_timestamp(F.try_to_timestamp(F.replace(F.substring(stamp, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))))


def rebased(path: str, root: str) -> Column:
    """A path below a root without the root; others stay."""
    return F.when(F.startswith(path, F.concat(F.col(root), F.lit("/"))), F.substring(F.col(path), F.length(root) + 2, F.length(path))).otherwise(F.col(path))


#: Where the 64-bit FNV-1a hash begins, and what is left of its factor 2^40 + 435.
_FNV_HIGH, _FNV_LOW, _FNV_FACTOR = 0xCBF29CE4, 0x84222325, 435


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's UTF-8 bytes, 16 hexadecimal digits; null of null.

    The hash is two halves of 32 bits, so no product passes 64: a step multiplies both by the factor's small part, and its 2^40 moves the lower one up by eight bits.
    """
    # an array of bytes: a step that named the text would compute it anew for each
    digits = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))
    mask = F.lit(0xFFFFFFFF).cast("bigint")
    begun = F.struct(F.lit(_FNV_HIGH).cast("bigint").alias("high"), F.lit(_FNV_LOW).cast("bigint").alias("low"))

    def step(h: Column, digit: Column) -> Column:
        byte = F.conv(digit, 16, 10).cast("bigint")
        low = h["low"].bitwiseXOR(byte)
        product = low * _FNV_FACTOR
        high = h["high"] * _FNV_FACTOR + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(mask).alias("high"), product.bitwiseAND(mask).alias("low"))

    half = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.aggregate(digits, begun, step, lambda h: F.concat(half(h["high"]), half(h["low"])))


def candidate_id(pattern: Column, crate: Column, modules: Column, evidence: Column) -> Column:
    """A stable name of a pattern found in a crate: of its sorted modules and its sorted distinct evidence, whatever order they come in."""
    parts = F.concat_ws("|", pattern, crate, F.array_join(F.array_sort(modules), ","), F.array_join(F.array_sort(F.array_distinct(evidence)), ","))
    return F.concat(F.lit("pattern:"), pattern, F.lit(":"), fnv1a(parts))
