"""Facts from Rust source text: a small lexer, functions with complexity, comments and syntactic findings.

The lexer blanks comments and literals but keeps offsets, so patterns only see code. This
is lower fidelity than a full parser inside macros and nested generics.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .items import spread
from .kept import Kept
from .names import GENERIC_WORDS

FUNCTIONS = "file string, name string, line int, is_pub boolean, is_test boolean, cyclomatic int, lines_of_code int, nesting_depth int, match_arm_count int, arg_count int"
COMMENTS = "file string, start_line int, end_line int, text string, is_doc boolean"
FINDINGS = "file string, line int, rule string, severity string"
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|b?r#*\"|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'", re.S)
_FN = re.compile(r"\bfn\s+(\w+)")
#: Marks of generated files, looked for in the first ten lines.
GENERATED = ("@generated", "DO NOT EDIT", "Code generated by", "automatically generated", "This file was automatically generated")
#: Literals keep their quotes, so this tells an operator from a closure without arguments.
_OR = re.compile(r"(?<!\bmove)(?<!\breturn)(?<=[\w)\]}?\"'])\s*\|\|")


def blank(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The source with literals and comments blanked, line breaks kept, and the comments' spans."""
    out, comments, at = [], [], 0
    while m := _TOKEN.search(source, at):
        end = m.end()
        if m[0].rstrip('"').endswith("#") or m[0] in ('r"', 'br"'):  # a raw string ends at its quote and as many hashes
            close = '"' + "#" * m[0].count("#")
            stop = source.find(close, end)
            end = len(source) if stop < 0 else stop + len(close)
        gap = re.sub(r"[^\n]", " ", source[m.start() : end])
        if not m[0].startswith(("//", "/*")) and len(gap) > 1:
            gap = f'"{gap[1:-1]}"'
        out += [source[at : m.start()], gap]
        if m[0].startswith(("//", "/*")):
            comments.append((m.start(), end))
        at = end
    return "".join([*out, source[at:]]), comments


def _close(code: str, at: int, pair: str) -> int:
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] == pair[0]) - (code[i] == pair[1])
        if not depth:
            return i
    return len(code) - 1


def functions(source: str) -> Iterator[tuple]:
    """name, line, is_pub, is_test, cyclomatic, lines, nesting, match arms, arguments of each function with a body."""
    code, _ = blank(source)
    for m in _FN.finditer(code):
        open_ = code.find("(", m.end())
        if open_ < 0:
            continue
        close = _close(code, open_, "()")
        body = re.compile(r"[{;]").search(code, close)
        if not body or body[0] == ";":
            continue
        end = _close(code, body.start(), "{}")
        text = code[body.start() : end + 1]
        for inner in list(_FN.finditer(text))[::-1]:  # nested functions count for themselves
            if (b := text.find("{", inner.end())) > 0:
                text = text[: inner.start()] + text[_close(text, b, "{}") + 1 :]
        arms = len(re.findall(r"=>", text))
        matches = len(re.findall(r"\bmatch\b", text))
        guards = len(re.findall(r"\bif\b[^{};]*=>", text))
        branches = len(re.findall(r"\b(?:if|while|for|loop)\b", text)) - guards
        cyclomatic = 1 + branches + text.count("&&") + len(_OR.findall(text)) + len(re.findall(r"\?(?=[;.)\s,])", text)) + max(arms - matches, 0) + guards
        depth = most = 0
        for c in text:
            depth += (c == "{") - (c == "}")
            most = max(most, depth)
        head = code[max(0, code.rfind("\n", 0, m.start() - 200 if m.start() > 200 else 0)) : m.start()]
        arguments = [a for a in re.split(r",(?![^<(]*[>)])", code[open_ + 1 : close]) if a.strip()]
        line_head = code[code.rfind("\n", 0, m.start()) + 1 : m.start()]
        tested = bool(re.search(r"#\[(?:\w+::)?test\]\s*(?:#\[[^\]]*\]\s*)*(?:pub\s+|async\s+)*$", head))
        yield m[1], code.count("\n", 0, m.start()) + 1, bool(re.search(r"\bpub\b", line_head)), tested, cyclomatic, text.count("\n") + 1, most - 1, arms, len(arguments)


def comments(source: str) -> Iterator[tuple[int, int, str, bool]]:
    for a, b in blank(source)[1]:
        text = source[a:b]
        yield source.count("\n", 0, a) + 1, source.count("\n", 0, b) + 1, re.sub(r"^(?://[/!]?|/\*[*!]?)|\*/$", "", text).strip(), text.startswith(("///", "//!", "/**", "/*!"))


#: rule, severity, pattern over blanked code.
PATTERNS = (
    ("panic-in-lib", "Warn", r"\.unwrap\(\)|\.expect\(|\bpanic!\s*\("),
    ("integer-cast-risk", "Warn", r"\bas\s+(?:u8|u16|u32|i8|i16|i32)\b(?!\s*\)?\s*\.\s*(?:clamp|min)\b)"),
    ("swallowed-result", "Warn", r"\blet\s+_\s*=\s*[\w:.]+\s*\(|\.ok\(\)\s*;"),
    ("empty-error-arm", "Warn", r"\bErr\(_\w*\)\s*=>\s*(?:\{\s*\}|\(\))"),
    ("suppression-debt", "Info", r"#!?\[(?:allow|expect)\("),
    ("merged-stub", "Warn", r"\b(?:todo|unimplemented)!\s*\("),
    ("tautological-test", "Warn", r"\bassert!\(\s*true\s*[,)]|\bassert_eq!\(\s*([\w.]+)\s*,\s*\1\s*[,)]"),
    ("ignored-test-accumulation", "Info", r"#\[ignore\b"),
    ("generic-naming", "Info", rf"(?i:\blet\s+(?:mut\s+)?(?:{'|'.join(GENERIC_WORDS)})\d+\b)"),
)


def findings(source: str) -> Iterator[tuple[int, str, str]]:
    """line, rule, severity."""
    code, spans = blank(source)
    line = lambda at: code.count("\n", 0, at) + 1
    for rule, severity, pattern in PATTERNS:
        for m in re.finditer(pattern, code):
            yield line(m.start()), rule, severity
    notes = [(source.count("\n", 0, a) + 1, source.count("\n", 0, b) + 1) for a, b in spans if "SAFETY" in source[a:b]]
    for m in re.finditer(r"\bunsafe\s*\{", code):
        at = line(m.start())
        if not any(b == at - 1 or a in (at, at + 1) for a, b in notes):
            yield at, "unsafe-surface", "Warn"
    docs = {source.count("\n", 0, b) + 1 for a, b in spans if source.startswith(("///", "/**"), a)}
    for m in re.finditer(r"^[ \t]*pub\s+(?:fn|struct|enum|trait|const|static|type|mod)\b", code, re.M):
        at = line(m.end())
        above = at - 1
        while above and code.split("\n")[above - 1].strip().startswith("#["):
            above -= 1
        if above not in docs:
            yield at, "undocumented-public-item", "Info"
    for name, at, _, test, *_ in functions(source):
        if test:
            open_ = code.find("{", [m.start() for m in _FN.finditer(code) if m[1] == name and line(m.start()) == at][0])
            body = code[open_ : _close(code, open_, "{}")]
            if not re.search(r"\b(?:assert\w*|panic|unreachable|debug_assert\w*|matches)!|\.(?:unwrap|expect|unwrap_err|expect_err)\(|\?", body):
                yield at, "assertion-free-test", "Warn"


def _table(files: DataFrame, rows, schema: str, columns: list[str]) -> DataFrame:
    """files: file, text. Null texts have no rows. A text that comes again within a task is read once."""

    def run(parts):
        kept = Kept(lambda s: list(rows(s)))
        for part in parts:
            found = [(f, *r) for f, s in zip(part["file"], part["text"], strict=True) if isinstance(s, str) for r in kept(s)]
            yield pd.DataFrame(found, columns=columns)

    return spread(files.select("file", "text")).mapInPandas(run, schema)


def function_table(files: DataFrame) -> DataFrame:
    return _table(files, functions, FUNCTIONS, ["file", "name", "line", "is_pub", "is_test", "cyclomatic", "lines_of_code", "nesting_depth", "match_arm_count", "arg_count"])


def comment_table(files: DataFrame) -> DataFrame:
    return _table(files, comments, COMMENTS, ["file", "start_line", "end_line", "text", "is_doc"])


def finding_table(files: DataFrame) -> DataFrame:
    return _table(files, findings, FINDINGS, ["file", "line", "rule", "severity"])


def source_kind(text: str) -> F.Column:
    """Authored, or Generated if one of the first ten lines says so, in these very letters."""
    head = F.array_join(F.slice(F.split(F.col(text), "\n"), 1, 10), "\n")
    marked = F.lit(False)
    for mark in GENERATED:
        marked |= head.contains(mark)
    return F.when(marked, "Generated").otherwise("Authored")


def usage_domain(path: str) -> F.Column:
    p = F.col(path)
    return F.when(p.rlike(r"(^|/)build\.rs$"), "Build").when(p.rlike(r"(^|/)(tests|examples|benches)/"), "Dev").otherwise("Normal")
