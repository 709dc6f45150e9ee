"""Rules on a function's text that need its tree: errors that say nothing, empty bodies, documentation that repeats the signature, branches on parts of strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .items import Facts, Kind, Node, _is, _macro_input, _table, _type_name
from .signatures import Signature, _walk

#: Words that say nothing beside a signature, the longest text that is compared, and from how many conditions on branches are a chain.
DOC_STOPWORDS = ("returns", "return", "get", "gets", "the", "a", "an", "of", "for")
DOC_WORDS, CHAIN = 6, 2
#: Names of checks for whole words, whatever their case.
WORD_CHECKS = ("is_word", "word_boundary", "is_word_boundary")


def _arguments(nodes: list[Node]) -> list[list[Node]]:
    """The parts of a type's nodes between commas outside <>."""
    out, depth = [[]], 0
    for at, n in enumerate(nodes):
        depth += (n.text == "<" and n.inner is None) - (n.text == ">" and n.inner is None and not _is(nodes, at - 1, "-"))
        if not depth and _is(nodes, at, ","):
            out.append([])
        else:
            out[-1].append(n)
    return out


def catch_all(nodes: list[Node], erased_names: bool = True) -> bool:
    """Whether a type is, or has among its arguments, an error that could be any: a trait object of Error, or, if erased_names, anyhow's Error or Result."""
    if not nodes:
        return False
    if _is(nodes, 0, "dyn"):
        bounds, last, depth = [], "", 0
        for n in nodes[1:]:
            depth += (n.text == "<") - (n.text == ">")
            if n.text == "+" and not depth:
                bounds.append(last)
            elif n.is_name and not depth:
                last = n.text
        return "Error" in [*bounds, last]
    if not (nodes[0].is_name or _is(nodes, 0, ":", ":")) or nodes[0].text in ("impl", "fn", "for"):
        return False
    segments, inner, at = [], [], 0
    while at < len(nodes):
        if nodes[at].text == "<" and nodes[at].inner is None:
            begin, depth = at + 1, 0
            while at < len(nodes):
                depth += (nodes[at].text == "<") - (nodes[at].text == ">" and not _is(nodes, at - 1, "-"))
                if not depth:
                    break
                at += 1
            inner += _arguments(nodes[begin:at])
        elif nodes[at].is_name:
            if nodes[at].text == "where":
                break
            segments.append(nodes[at].text)
        at += 1
    if erased_names and len(segments) >= 2 and segments[-2] == "anyhow" and segments[-1] in ("Error", "Result"):
        return True
    return any(catch_all(a, erased_names) for a in inner)


def _inner_functions(nodes: list[Node]) -> list[Node]:
    """The nodes without the bodies of functions in them."""
    out, at = [], 0
    while at < len(nodes):
        if _is(nodes, at, "fn") and at + 1 < len(nodes) and nodes[at + 1].is_name:
            while at < len(nodes) and not nodes[at].is_group("{") and not _is(nodes, at, ";"):
                at += 1
            at += 1
            continue
        n = nodes[at]
        out.append(n if n.inner is None or _macro_input(nodes, at) else Node(n.text, n.line, _inner_functions(n.inner)))
        at += 1
    return out


def _drops_error(body: list[Node]) -> bool:
    """Whether a map_err is given a closure that ignores what it gets."""
    for level, at in _walk(body):
        if level[at].text == "map_err" and level[at].inner is None and _is(level, at - 1, ".") and at + 1 < len(level) and level[at + 1].is_group("("):
            given = level[at + 1].inner
            given = given[1:] if _is(given, 0, "move") else given
            if _is(given, 0, "|", "_") and (_is(given, 2, "|") or _is(given, 2, ":")):
                return True
    return False


def _restates(doc: str, name: str, signature: Signature, back: list[Node], params: list[list[Node]]) -> bool:
    words = re.findall(r"[^\W_]+", doc.lower())
    said = [w for w in words if w not in DOC_STOPWORDS]
    if not said or len(words) > DOC_WORDS:
        return False
    known = {name.lower()}
    if signature.returns is not None:
        known.add(_type_name(back).lower())
    own = [p for p in params if p and not any(n.text == "self" and n.inner is None for n in p[: next((i for i, n in enumerate(p) if n.text == ":"), len(p))])]
    if len(own) == 1:
        p = own[0][1:] if _is(own[0], 0, "mut") else own[0]
        if len(p) > 2 and p[0].is_name and _is(p, 1, ":"):
            known.add(p[0].text.lower())
        colon = next((i for i, n in enumerate(p) if n.inner is None and n.text == ":"), None)
        if colon is not None:
            known.add(_type_name(p[colon + 1 :]).lower())
    return all(w in known for w in said)


def _fragile(condition: list[Node]) -> bool:
    part = whole = False
    for level, at in _walk(condition):
        n = level[at]
        if _is(level, at, "=", "=") and not _is(level, at - 1, "="):
            whole = True
        if n.is_name and at + 1 < len(level) and level[at + 1].is_group("("):
            method = _is(level, at - 1, ".")
            given = level[at + 1].inner
            if method and n.text == "contains" and len(given) == 1 and given[0].inner is None and given[0].text[-1] in '"#' and not given[0].text.startswith(("b", "c")):
                part = True
            whole |= method and n.text == "split_whitespace" or n.text.lower() in WORD_CHECKS
    return part and not whole


def _chains(body: list[Node]) -> Iterator[int]:
    """Lines of ifs with an else if of which one condition asks for a part of a string and none of that condition for a whole word."""
    for level, at in _walk(body):
        if not _is(level, at, "if") or _is(level, at - 1, "else"):
            continue
        conditions, head = [], at
        while True:
            end = head + 1
            while end < len(level) and not level[end].is_group("{") and not _is(level, end, "=", ">"):
                end += 1
            if end >= len(level) or not level[end].is_group("{"):
                break
            conditions.append(level[head + 1 : end])
            if not _is(level, end + 1, "else", "if"):
                break
            head = end + 2
        if len(conditions) >= CHAIN and any(map(_fragile, conditions)):
            yield level[at].line


def rules(f: Facts) -> Iterator[tuple[int, str, str, str]]:
    """line, rule, severity, item."""
    for line, name, _, public, nodes, attributes, where in f.functions:
        body = nodes[-1].inner or []
        docs = [a.text.removeprefix("///").removeprefix("/**").removesuffix("*/") for a in attributes if a.is_doc]
        docs += [a.inner[2].text.strip('"') for a in attributes if a.inner and len(a.inner) > 2 and a.inner[0].text == "doc" and a.inner[2].inner is None]
        place = next((i for i, n in enumerate(nodes) if n.is_group("(")), None)
        back = nodes[place + 3 : -1] if place is not None and _is(nodes, place + 1, "-", ">") else []
        own = _inner_functions(body)
        if where != "trait":
            if public and catch_all(back) and _drops_error(own):
                yield line, "catch-all-error", "Warn", name
            text = " ".join(docs).strip()
            if text and place is not None and _restates(text, name.rsplit("::", 1)[-1], Signature(nodes), back, _arguments(nodes[place].inner)):
                yield line, "doc-restates-signature", "Info", name
        if docs and not body:
            yield line, "empty-impl", "Warn", name
        for at in _chains(own):
            yield at, "fragile-substring-classification", "Warn", name


RULES = "file string, line int, rule string, severity string, item string"
RULE_ROWS: Kind = (rules, RULES)


def rule_table(files: DataFrame) -> DataFrame:
    return _table(files, RULE_ROWS)
