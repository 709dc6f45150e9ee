"""Source texts as tokens, and streams of tokens normalised for comparison.

A token is a string literal, a character, a number, an identifier or keyword, or a single sign; comments are none, a lifetime is its quote and its name. What
kind a token is shows in its own text, so a stream is an array of strings. Comments nest; raw strings end at their own number of hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

from .names import KEYWORDS, LITERALS

#: The first alternatives are the commonest: words that can't begin a literal, and signs that begin nothing longer.
_COMMON = r"[^\W\dbcr]\w*|[(){}\[\],;:.<>=&!|+*?-]|//[^\n]*"
_REST = (
    r"[bc]?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[^}]*\}|.)|[^'\\])'|r\#[^\W\d]\w*"
    r"|0[xob]\w+|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?\d[\d_]*)?\w*|[^\W\d]\w*|\S"
)
_TOKEN = re.compile(rf"{_COMMON}|/\*|[bc]?r(\#*)\".*?\"\1|{_REST}", re.S)
#: The same for sources without raw strings and comments that nest, and line breaks as tokens.
_SIMPLE = re.compile(rf"[ \t]*(\n|{_COMMON}|{_REST})", re.S)
#: And without them: what is left has no group, so that findall() gives the tokens themselves; with the white space before each.
_PLAIN = re.compile(rf"{_COMMON}|{_REST}", re.S)
_PLAIN_GAPS = re.compile(rf"\s*(?:{_COMMON}|{_REST})", re.S)
_EDGE = re.compile(r"/\*|\*/")
MODES = ("strict", "mild", "weak", "semantic")
_KEYWORDS = frozenset(KEYWORDS)
#: Identifiers that name where they stand.
_PLACES = frozenset(("self", "Self", "crate", "super"))


def spans(source: str, docs: bool = False) -> Iterator[tuple[int, int]]:
    """Begin and end of each token; if asked for, of each outer documentation comment too."""
    at = 0
    while m := _TOKEN.search(source, at):
        at = m.end()
        text = m[0]
        if text.startswith("//"):
            if docs and text.startswith("///") and not text.startswith("////"):
                yield m.start(), at
            continue
        if text == "/*":
            depth = 1
            while depth and (edge := _EDGE.search(source, at)):
                depth += 1 if edge[0] == "/*" else -1
                at = edge.end()
            if depth:  # an open comment takes the rest
                return
            if docs and source.startswith("/**", m.start()) and source[m.start() + 3] not in "*/":
                yield m.start(), at
            continue
        yield m.start(), at


def with_lines(source: str) -> Iterator[tuple[str, int]]:
    """Each token and outer documentation comment with the line that it begins on, from 1."""
    if "/*" in source or 'r"' in source or "r#" in source:
        return _with_lines_of_all(source)
    found = _SIMPLE.findall(source)
    lines = "\n" in source
    if not lines and "//" not in source:
        return zip(found, repeat(1), strict=False)
    out, line = [], 1
    for text in found:
        if text == "\n":
            line += 1
        elif text[0] != "/" or not text.startswith("//") or (text.startswith("///") and not text.startswith("////")):
            out.append((text, line))
            if lines and len(text) > 2 and "\n" in text:
                line += text.count("\n")
    return iter(out)


def _with_lines_of_all(source: str) -> Iterator[tuple[str, int]]:
    """The same of a source with raw strings or comments that nest."""
    line, last = 1, 0
    for a, b in spans(source, docs=True):
        line += source.count("\n", last, a)
        last = a
        yield source[a:b], line


def tokens(source: str) -> list[str]:
    if "/*" not in source and 'r"' not in source and "r#" not in source:
        found = _PLAIN.findall(source)
        return [t for t in found if t[0] != "/" or not t.startswith("//")] if "//" in source else found
    if "/*" not in source:
        return [m[0] for m in _TOKEN.finditer(source) if not m[0].startswith("//")]
    return [source[a:b] for a, b in spans(source)]


def with_gaps(source: str) -> list[str]:
    """Each token with what stands between it and the one before; the first alone."""
    if "/*" not in source and "//" not in source and 'r"' not in source and "r#" not in source:
        found = _PLAIN_GAPS.findall(source.rstrip())
        return [found[0].lstrip(), *found[1:]] if found else found
    out, last = [], None
    for a, b in spans(source):
        out.append(source[a if last is None else last : b])
        last = b
    return out


def literal_kind(token: str) -> str | None:
    """A key of names.LITERALS, or None for other tokens."""
    first, last = token[0], token[-1]
    if first.isdigit():
        if token[:2] in ("0x", "0o", "0b"):
            return "int"
        return "float" if "." in token or re.fullmatch(r"[\d_]+(?:[eE][+-]?[\d_]+)?f(?:32|64)|[\d_]+[eE][+-]?[\d_]+", token) else "int"
    if len(token) > 1 and last in "\"'#":
        head = token[: min(token.find(q) for q in "\"'" if q in token)] if '"' in token or "'" in token else None
        if head is None:
            return None
        if last == "'":
            return "byte" if head == "b" else "char"
        return "bytestr" if head.startswith("b") else "verbatim" if head.startswith("c") else "str"
    return "bool" if token in ("true", "false") else None


def _is_name(token: str) -> bool:
    return token[0] == "_" or token[0].isalpha()


def may_be_variable(token: str) -> bool:
    """Whether a token that is no literal can be a variable's name, wherever it stands."""
    return _is_name(token) and token not in _KEYWORDS and token not in _PLACES and not token[0].isupper()


def literal_kinds(toks: list[str]) -> list[str | None]:
    """literal_kind() of each; a word of letters can be a truth value and no other literal."""
    return [(None if t != "true" and t != "false" else "bool") if t.isalpha() else literal_kind(t) for t in toks]


def may_be_variables(toks: list[str]) -> list[bool]:
    """may_be_variable() of each."""
    return [(t not in _KEYWORDS and t not in _PLACES and not t[0].isupper()) if t.isalpha() else may_be_variable(t) for t in toks]


def normalised(toks: list[str], mode: str, kinds: dict[str, str | None] | None = None) -> list[str]:
    """mild: the tokens. weak: literals as what stands for their kind. semantic: besides, names that look like variables of the function by the order of
    their first occurrence in it.

    A name keeps its text that is called or a macro's (a parenthesis or exclamation mark follows), stands beside ::, follows a dot, is a keyword or names a
    place, or begins with a capital. kinds: a cache of literal kinds, which the caller bounds.
    """
    if mode == "mild":
        return toks
    kinds = {} if kinds is None else kinds
    out, number, n = [], {}, len(toks)
    for i, tok in enumerate(toks):
        if tok not in kinds:
            kinds[tok] = literal_kind(tok)
        kind = kinds[tok]
        if kind is not None:
            out.append(LITERALS[kind])
        elif mode == "weak" or not may_be_variable(tok):
            out.append(tok)
        elif i + 1 < n and (toks[i + 1] in ("(", "!") or (toks[i + 1] == ":" and i + 2 < n and toks[i + 2] == ":")):
            out.append(tok)
        elif i and (toks[i - 1] == "." or (i > 1 and toks[i - 1] == ":" and toks[i - 2] == ":")):
            out.append(tok)
        else:
            out.append(f"__ID_{number.setdefault(tok, len(number))}__")
    return out
