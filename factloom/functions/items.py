"""Facts about a source's items, from a tree of its tokens: use paths, items with qualified names, enum variants, what is constructed, paths into other packages.

Tokens between brackets are one node of the tree, so nesting, groups, raw strings and comments need no patterns. What this sees is syntax: a macro's input
is opaque, as it is to a parser, and a name is what is written. Works per text, so that Spark's tasks map it over files of any number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import Stored
from . import tokens
from .kept import Kept

#: How deep brackets are a tree.
DEEPEST = 200
_CLOSE = {"(": ")", "[": "]", "{": "}"}
_BRACKETS = frozenset("()[]{}")
_MODIFIERS = frozenset(("async", "unsafe", "default", "auto"))
#: What an item, or what stands before one, begins with.
_HEADS = _MODIFIERS | frozenset(("#", "pub", "extern", "const", "static", "use", "mod", "struct", "enum", "trait", "impl", "type", "fn", "macro_rules"))
#: Words that begin what is no plain value.
_TURNS = frozenset(("pub", "let", "for", "match", "fn", "macro_rules", "struct", "enum", "union", "type", "use", "trait", "impl", "mod", "const", "static", "as"))
_LEADING = frozenset(("self", "super", "crate", "Self"))
#: Where a closure's first bar can stand, so that a bar elsewhere is an operator.
_BEFORE_CLOSURE = frozenset(("", "(", ",", "=", "move", ">", "return", ";", "{", "&", "|", ":"))


class Node:
    """A token, or a pair of brackets with the nodes between them: text is then the opening one."""

    __slots__ = ("inner", "is_name", "line", "text")

    def __init__(self, text: str, line: int, inner: list[Node] | None = None) -> None:
        self.text = text
        self.line = line
        self.inner = inner
        first = text[0]
        self.is_name = (first.isalpha() or first == "_") and text[-1] not in "\"'#"

    def is_group(self, bracket: str) -> bool:
        return self.inner is not None and self.text == bracket

    @property
    def is_doc(self) -> bool:
        return self.inner is None and self.text.startswith(("///", "/**"))


def tree(source: str) -> list[Node]:
    """The nodes of a source."""
    return _tree(source)[0]


def _tree(source: str) -> tuple[list[Node], bool]:
    """The nodes of a source, and whether all brackets are closed. A closing bracket that none opened is a token; what is never closed ends with the text. Brackets nested deeper than DEEPEST are plain tokens, in one list with what they hold."""
    top: list[Node] = []
    level = top
    open_: list[list[Node]] = [top]
    wanted: list[str] = [""]
    flat: list[str] = []  # closing brackets of those that are too deep
    for text, line in tokens.with_lines(source):
        if text not in _BRACKETS:
            level.append(Node(text, line))
        elif text in _CLOSE:
            if len(wanted) > DEEPEST:
                flat.append(_CLOSE[text])
                level.append(Node(text, line))
            else:
                node = Node(text, line, [])
                level.append(node)
                level = node.inner
                open_.append(level)
                wanted.append(_CLOSE[text])
        elif flat and text == flat[-1]:
            flat.pop()
            level.append(Node(text, line))
        elif text == wanted[-1]:
            open_.pop()
            wanted.pop()
            level = open_[-1]
        else:
            level.append(Node(text, line))
    return top, len(wanted) == 1


def _is(nodes: list[Node], at: int, *texts: str) -> bool:
    n = len(nodes)
    for t in texts:
        if at >= n:
            return False
        node = nodes[at]
        if node.text != t or node.inner is not None:
            return False
        at += 1
    return True


def _macro_input(nodes: list[Node], at: int) -> bool:
    """Whether the brackets at a place are what a macro is given, which is no code yet: not those after a not, nor a block."""
    return at > 1 and _is(nodes, at - 1, "!") and nodes[at - 2].is_name and nodes[at - 2].text not in tokens._KEYWORDS


def use_leaves(nodes: list[Node], before: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str | None, bool]]:
    """Path, alias and whether it is a glob of each leaf of a use tree's nodes. A glob's path is that of what it takes all of; a renamed leaf keeps its own name in the path."""
    path, at = list(before), 0
    while at < len(nodes):
        node = nodes[at]
        if node.is_group("{"):
            begin = 0
            for end in [i for i, n in enumerate(node.inner) if n.inner is None and n.text == ","] + [len(node.inner)]:
                if end > begin:
                    yield from use_leaves(node.inner[begin:end], tuple(path))
                begin = end + 1
            return
        if node.text == "*":
            yield tuple(path), None, True
            return
        if node.is_name:
            path.append(node.text.removeprefix("r#"))
            if _is(nodes, at + 1, "as"):
                yield tuple(path), nodes[at + 2].text if at + 2 < len(nodes) else None, False
                return
            if at + 1 >= len(nodes):
                yield tuple(path), None, False
        at += 1


def _tests(attributes: list[Node]) -> bool:
    """Whether one of an item's attributes is a cfg that has the word test."""
    for a in attributes:
        if a.inner and a.inner[0].text == "cfg" and len(a.inner) > 1 and a.inner[1].is_group("("):
            todo = list(a.inner[1].inner)
            while todo:
                n = todo.pop()
                todo += n.inner or []
                if n.inner is None and "test" in n.text.replace('"', " ").replace("-", " ").split():
                    return True
    return False


def _derives(attributes: list[Node], trait: str) -> bool:
    """Whether a derive has a path that ends with the trait."""
    for a in attributes:
        if a.inner and a.inner[0].text == "derive" and len(a.inner) > 1 and a.inner[1].is_group("("):
            given = a.inner[1].inner
            if any(n.text == trait and (at + 1 == len(given) or _is(given, at + 1, ",")) for at, n in enumerate(given)):
                return True
    return False


def _type_name(nodes: list[Node]) -> str:
    """The last segment of a type's path before its arguments; ? for what is no path."""
    last, depth = "?", 0
    for at, n in enumerate(nodes):
        if n.inner is not None or n.text in ("&", "*", "dyn", "!", "impl"):
            return last if last != "?" else "?"
        depth += (n.text == "<") - (n.text == ">" and not _is(nodes, at - 1, "-"))
        if n.text == "where":
            break
        if not depth and n.is_name:
            last = n.text
    return last


class Facts:
    """What a source has: uses (line, public, path, alias, glob, in_test), items (line, kind, name, public, in_test), variants (line, name, variant, public, in_test),
    constructed (variant names), paths (first and second segment, in_test). For signatures.py also functions (line, name, owner, public, its nodes from the name to the body, attributes and documentation, where it stands) and
    structs (line, name, public, attributes, its body's nodes), whether Drop is implemented, and errors (line, name): enums with Error in their name, items that derive an
    Error, and types that Error is implemented for."""

    def __init__(self, source: str) -> None:
        self.functions: list[tuple] = []
        self.structs: list[tuple] = []
        self.drops = False
        self.errors: list[tuple[int, str]] = []
        self.uses: list[tuple] = []
        self.items: list[tuple] = []
        self.variants: list[tuple] = []
        self._nodes, closed = _tree(source)
        self._ends = [closed, self._items(self._nodes, (), "mod", False) <= len(self._nodes)]

    @property
    def closed(self) -> bool:
        """Whether nothing that follows the source could change what was asked of it so far, but for how its last tokens are read."""
        return all(self._ends) and bool(self._nodes) and (self._nodes[-1].is_group("{") or _is(self._nodes, len(self._nodes) - 1, ";"))

    @cached_property
    def constructed(self) -> set[str]:
        found: set[str] = set()
        self._ends.append(self._expressions(self._nodes, found) <= len(self._nodes))
        return found

    @cached_property
    def paths(self) -> set[tuple[str, str | None, bool]]:
        found: set[tuple[str, str | None, bool]] = set()
        for _, _, path, _, _, test in self.uses:
            first, *more = path.split("::")
            if first and first not in _LEADING:
                found.add((first, more[0] if more else None, test))
        self._ends.append(self._paths(self._nodes, False, found))
        return found

    def _items(self, nodes: list[Node], path: tuple[str, ...], where: str, in_test: bool) -> int:
        """where: mod, trait, impl or body. A function's body adds nothing to the names of the items in it. Gives back where it ends: behind the end if it looked for one that isn't there."""
        at, starts, attributes, public, n = 0, True, [], False, len(nodes)
        name = lambda n: "::".join((*path, n))
        while at < n:
            node = nodes[at]
            text = node.text
            if node.inner is None and (text not in _HEADS if starts else text != "#") and text[0] != "/":  # begins nothing
                starts = text == ";"
                if attributes:
                    attributes = []
                public = False
                at += 1
                continue
            if node.is_doc:
                attributes.append(node)
                at += 1
                continue
            if node.text == "#" and node.inner is None and at + 1 < len(nodes):
                inner = at + (2 if _is(nodes, at + 1, "!") else 1)
                if inner < len(nodes) and nodes[inner].is_group("["):
                    attributes.append(nodes[inner])
                    at = inner + 1
                    continue
            if starts and node.inner is None and node.text == "pub":
                public, at = True, at + 1
                if at < len(nodes) and nodes[at].is_group("("):
                    public, at = False, at + 1
                continue
            if starts and node.inner is None and node.text in _MODIFIERS and at + 1 < len(nodes):
                at += 1
                continue
            if starts and node.inner is None and node.text == "extern" and at + 1 < len(nodes) and nodes[at + 1].text[:1] in ('"', "f"):
                at += 2 if nodes[at + 1].text.startswith('"') else 1
                continue
            if starts and node.inner is None and node.text == "const" and any(_is(nodes, at + 1, w) for w in ("fn", "unsafe", "async", "extern")):
                at += 1
                continue
            follows = nodes[at + 1] if at + 1 < len(nodes) else None
            test = in_test or bool(attributes) and _tests(attributes)
            kind = node.text if starts and node.inner is None else ""
            end = None
            if kind == "use":
                end = self._until(nodes, at, ";")
                for leaf, alias, glob in use_leaves(nodes[at + 1 : end]):
                    self.uses.append((node.line, public, "::".join(leaf), alias, glob, test))
            elif kind == "mod" and follows is not None and follows.is_name:
                end = self._until(nodes, at, ";", "{")
                if end < len(nodes) and nodes[end].inner is not None:
                    self._items(nodes[end].inner, (*path, follows.text), "mod", test)
            elif kind in ("struct", "enum", "trait") and follows is not None and follows.is_name:
                end = self._until(nodes, at, ";", "{")
                self.items.append((follows.line, kind, name(follows.text), public, test))
                if kind != "trait" and (_derives(attributes, "Error") or (kind == "enum" and "Error" in follows.text)):
                    self.errors.append((follows.line, name(follows.text)))
                if kind == "struct" and end < len(nodes) and nodes[end].inner is not None:
                    self.structs.append((follows.line, follows.text, public, attributes, nodes[end].inner))
                elif end < len(nodes) and nodes[end].inner is not None:
                    if kind == "enum":
                        self._variants(nodes[end].inner, name(follows.text), public, test)
                    else:
                        self._items(nodes[end].inner, (*path, follows.text), "trait", test)
            elif kind == "impl":
                end = self._until(nodes, at, "{")
                head = self._without_generics(nodes[at + 1 : end])
                turn = next((i for i, n in enumerate(head) if n.inner is None and n.text == "for" and not _is(head, i + 1, "<")), None)
                given = _type_name(head[:turn]) if turn is not None else ""
                self.drops |= given == "Drop"
                if given == "Error":
                    self.errors.append((node.line, name(_type_name(head[turn + 1 :]))))
                if end < len(nodes):
                    self._items(nodes[end].inner, (*path, _type_name(head if turn is None else head[turn + 1 :])), "impl", test)
            elif kind in ("const", "static") and follows is not None and (follows.is_name or follows.text == "mut"):
                end = self._until(nodes, at, ";")
                named = nodes[at + 2] if follows.text == "mut" and at + 2 < len(nodes) else follows
                if named.text != "_" and where != "trait":
                    self.items.append((named.line, kind, name(named.text), public, test))
            elif kind == "type" and follows is not None and follows.is_name:
                end = self._until(nodes, at, ";")
                if where == "impl":
                    self.items.append((follows.line, "type", name(follows.text), public, test))
            elif kind == "fn" and follows is not None and follows.is_name:
                end = self._until(nodes, at, ";", "{")
                if end < len(nodes) and nodes[end].inner is not None:
                    self.items.append((follows.line, "fn", name(follows.text), public, test))
                    self.functions.append((follows.line, name(follows.text), path[-1] if where == "impl" else None, public, nodes[at + 2 : end + 1], attributes, where))
                    self._items(nodes[end].inner, path, "body", test)
            elif kind == "macro_rules":
                end = self._until(nodes, at, ";", "{", "(")
            elif node.inner is not None and not _macro_input(nodes, at):
                self._items(node.inner, path, "body", test)  # blocks within a body
            if end is not None:
                at = end
            node = nodes[at] if at < len(nodes) else node
            starts = node.inner is not None and node.text == "{" or node.inner is None and node.text == ";"
            attributes, public = [], False
            at += 1
        return at

    @staticmethod
    def _until(nodes: list[Node], at: int, *ends: str) -> int:
        while at < len(nodes) and not (nodes[at].text in ends and (nodes[at].inner is not None) == (nodes[at].text in _CLOSE)):
            at += 1
        return at

    @staticmethod
    def _without_generics(nodes: list[Node]) -> list[Node]:
        if not nodes or nodes[0].text != "<" or nodes[0].inner is not None:
            return nodes
        depth = 0
        for at, n in enumerate(nodes):
            depth += (n.text == "<") - (n.text == ">" and not _is(nodes, at - 1, "-"))
            if not depth:
                return nodes[at + 1 :]
        return []

    def _variants(self, nodes: list[Node], enum: str, public: bool, test: bool) -> None:
        begins = True
        at = 0
        while at < len(nodes):
            n = nodes[at]
            if n.text == "#" and at + 1 < len(nodes) and nodes[at + 1].is_group("["):
                at += 2
                continue
            if begins and n.is_name:
                self.variants.append((n.line, f"{enum}::{n.text}", n.text, public, test))
                begins = False
            elif n.inner is None and n.text == ",":
                begins = True
            at += 1

    # -- expressions and patterns

    def _expressions(self, nodes: list[Node], found: set[str]) -> int:
        """Takes the last segment of every path that stands where a value does: not in a pattern, a type, a signature, an attribute or a macro's input. Gives back where it ends, as _items() does."""
        at, before = 0, ""
        while at < len(nodes):
            n = nodes[at]
            if n.inner is not None:
                if not _macro_input(nodes, at):
                    self._expressions(n.inner, found)
                before, at = n.text, at + 1
                continue
            text = n.text
            if n.is_name and text not in _TURNS:
                if before != "." and text not in tokens._KEYWORDS:
                    end = self._past_path(nodes, at)
                    if not _is(nodes, end, "!") and not (end == at + 1 and _is(nodes, end, ":")):
                        found.add(text if end == at + 1 else self._last_name(nodes[at:end]))
                    at, before = end, "name"
                else:
                    before = text
                    at += 1
                continue
            if text == "#" and at + 1 < len(nodes) and (nodes[at + 1].is_group("[") or (_is(nodes, at + 1, "!") and at + 2 < len(nodes) and nodes[at + 2].is_group("["))):
                at += 2 if nodes[at + 1].inner is not None else 3
                continue
            if text == "pub" and at + 1 < len(nodes) and nodes[at + 1].is_group("("):
                at += 1
            elif text == "let":
                at = self._to_value(nodes, at)
            elif text == "for" and not _is(nodes, at + 1, "<"):
                at = self._until(nodes, at, "in", "{")
            elif text == "match":
                end = self._until(nodes, at + 1, "{")
                self._expressions(nodes[at + 1 : end], found)
                if end < len(nodes):
                    self._arms(nodes[end].inner, found)
                at = end + 1
                before = "{"
                continue
            elif text == "fn":
                at = self._until(nodes, at, "{", ";")
                before = ""
                continue
            elif text == "macro_rules" and _is(nodes, at + 1, "!"):
                at = self._until(nodes, at, "{", "(", "[", ";") + 1
                before = ";"
                continue
            elif text in ("struct", "enum", "union", "type", "use", "trait", "impl", "mod"):
                end = self._until(nodes, at, ";", "{")
                if end < len(nodes) and nodes[end].inner is not None and text in ("trait", "impl", "mod"):
                    self._expressions(nodes[end].inner, found)
                at = end + 1
                before = ";"
                continue
            elif text in ("const", "static") and at + 1 < len(nodes) and nodes[at + 1].is_name and nodes[at + 1].text != "fn":
                at = self._to_value(nodes, at)
            elif text == "as":
                at = self._past_path(nodes, at + 1)
                continue
            elif text == "|" and before in _BEFORE_CLOSURE:
                at = self._until(nodes, at + 1, "|")
            elif text in _TURNS and text not in tokens._KEYWORDS and before != ".":
                end = self._past_path(nodes, at)
                if not _is(nodes, end, "!") and not (end == at + 1 and _is(nodes, end, ":")):
                    found.add(self._last_name(nodes[at:end]))
                at, before = end, "name"
                continue
            before = nodes[at].text if at < len(nodes) else ""
            at += 1
        return at

    @staticmethod
    def _to_value(nodes: list[Node], at: int) -> int:
        """Where a let's or a constant's = stands, or its end."""
        while at < len(nodes):
            if _is(nodes, at, ";"):
                return at
            if _is(nodes, at, "=") and not _is(nodes, at + 1, "=") and not _is(nodes, at - 1, "."):
                return at
            at += 1
        return at

    def _arms(self, nodes: list[Node], found: set[str]) -> None:
        at = 0
        while at < len(nodes):
            guard = None
            while at < len(nodes) and not _is(nodes, at, "=", ">"):
                if guard is None and _is(nodes, at, "if"):
                    guard = at + 1
                at += 1
            if guard is not None:
                self._expressions(nodes[guard:at], found)
            at += 2
            end = at
            if at < len(nodes) and nodes[at].is_group("{") and not (at + 1 < len(nodes) and nodes[at + 1].inner is None and nodes[at + 1].text in (".", "?")):
                end = at + 1
                self._expressions(nodes[at].inner, found)
                at = end + (1 if _is(nodes, end, ",") else 0)
                continue
            while end < len(nodes) and not _is(nodes, end, ","):
                end += 1
            self._expressions(nodes[at:end], found)
            at = end + 1

    @staticmethod
    def _past_path(nodes: list[Node], at: int) -> int:
        """Behind a path: names, :: and type arguments in <>; behind the end if these aren't closed."""
        if at < len(nodes) and nodes[at].is_name and (at + 1 >= len(nodes) or nodes[at + 1].text != ":"):
            return at + 1
        while at < len(nodes):
            if nodes[at].is_name:
                at += 1
            if _is(nodes, at, ":", ":", "<"):
                at += 2
            if _is(nodes, at, "<") and at and _is(nodes, at - 1, ":"):
                depth = 0
                while at < len(nodes):
                    depth += (nodes[at].text == "<") - (nodes[at].text == ">" and not _is(nodes, at - 1, "-"))
                    at += 1
                    if not depth:
                        break
                else:
                    return at + 1
            if not _is(nodes, at, ":", ":"):
                return at
            at += 2
        return at

    @staticmethod
    def _last_name(nodes: list[Node]) -> str:
        last, depth = "", 0
        for at, n in enumerate(nodes):
            depth += (n.text == "<") - (n.text == ">" and not _is(nodes, at - 1, "-"))
            if not depth and n.is_name:
                last = n.text
        return last

    # -- paths into other packages

    def _paths(self, nodes: list[Node], in_test: bool, found: set[tuple[str, str | None, bool]]) -> bool:
        """First and second segment of each path of two or more, and the name of each macro. Names that stand alone aren't told from variables. Gives back whether no attribute waits for its item at the end."""
        at, attributes = 0, []
        while at < len(nodes):
            n = nodes[at]
            if n.text == "#" and n.inner is None and at + 1 < len(nodes) and nodes[at + 1].is_group("["):
                attributes.append(nodes[at + 1])
                at += 2
                continue
            if n.inner is None and n.text == "use":
                at, attributes = self._until(nodes, at, ";"), []
            elif n.inner is None and n.text == "mod":
                end = self._until(nodes, at, ";", "{")
                if end < len(nodes) and nodes[end].inner is not None:
                    self._paths(nodes[end].inner, in_test or _tests(attributes), found)
                at, attributes = end, []
            elif n.inner is not None:
                if not _macro_input(nodes, at):
                    self._paths(n.inner, in_test, found)
                attributes = [] if n.text == "{" else attributes
            elif n.is_name and at + 1 < len(nodes) and nodes[at + 1].text in (":", "!") and not (at and (_is(nodes, at - 1, ":") or _is(nodes, at - 1, "."))) and n.text not in _LEADING:
                if _is(nodes, at + 1, ":", ":"):
                    second = nodes[at + 3].text if at + 3 < len(nodes) and nodes[at + 3].is_name else None
                    found.add((n.text, second, in_test))
                elif _is(nodes, at + 1, "!") and at + 2 < len(nodes) and nodes[at + 2].inner is not None:
                    found.add((n.text, None, in_test))
            at += 1
        return at == len(nodes) and not attributes


USES = "file string, line int, public boolean, path string, alias string, glob boolean, in_test boolean"
ITEMS = "file string, line int, kind string, name string, public boolean, in_test boolean"
VARIANTS = "file string, line int, name string, variant string, public boolean, in_test boolean"
CONSTRUCTED = "file string, variant string"
PATHS = "file string, first string, second string, in_test boolean"


#: What a table takes from each file's facts, and its schema, which begins with the file.
Kind = tuple[Callable[[Facts], Iterable[tuple]], str]
USE_ROWS: Kind = (lambda f: f.uses, USES)
ITEM_ROWS: Kind = (lambda f: f.items, ITEMS)
VARIANT_ROWS: Kind = (lambda f: f.variants, VARIANTS)
CONSTRUCTED_ROWS: Kind = (lambda f: ((v,) for v in sorted(f.constructed)), CONSTRUCTED)
PATH_ROWS: Kind = (lambda f: sorted(f.paths, key=str), PATHS)
ERROR_ROWS: Kind = (lambda f: f.errors, "file string, line int, name string")


def spread(files: DataFrame) -> DataFrame:
    """The files (file, text) dealt over all tasks by their hash. Parsing takes far longer than reading, and a table of small texts is one row group, which one task would parse."""
    spark = files.sparkSession
    return files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "file", "text")


#: Where a source is cut in pieces: behind a line that ends an item, before one that begins in the first column.
_CUT = re.compile(r"(?<=[};])\n+(?=[^\s}])")


class _Piece:
    """A part of a source that begins where an item can: the rows of each kind, how many line breaks it has, and whether what follows can't change its rows."""

    __slots__ = ("closed", "lines", "rows")

    def __init__(self, text: str, kinds: tuple[Kind, ...]) -> None:
        facts = Facts(text)
        self.rows = [list(rows(facts)) for rows, _ in kinds]
        self.lines = text.count("\n")
        self.closed = facts.closed and not _runs_on(text)


def _runs_on(text: str) -> bool:
    """Whether a comment or literal of a text may not be closed: a quote or backslash is a token, or it has comments or raw strings that would need a closer look."""
    if "/*" in text or 'r"' in text or "r#" in text:
        return True
    return ('"' in text or "\\" in text) and not {'"', "\\"}.isdisjoint(tokens.tokens(text))


def _pieces(source: str, kept: Kept) -> Iterator[tuple[_Piece, int]]:
    """The pieces of a source and how many line breaks are before each. From a piece on that what follows could change, the source is one piece, so that all rows are those of the whole."""
    at = line = 0
    for cut in (*(m.end() for m in _CUT.finditer(source)), len(source)):
        piece = kept(source[at:cut])
        if not piece.closed and cut < len(source):
            yield kept(source[at:]), line
            return
        yield piece, line
        line += piece.lines
        at = cut


def _has_lines(kind: Kind) -> bool:
    """Whether a kind's rows begin with a line; others are a set of the whole file's."""
    return kind[1].startswith("file string, line int")


def _facts(texts: list[str | None], kinds: tuple[Kind, ...], kept: Kept, types: list[pa.StructType]) -> list[tuple[np.ndarray, pa.StructArray]]:
    """For each kind, which text each row is of, by its place, and the rows. What stands in many places becomes Arrow values once, and is taken from there."""
    number: dict[int, int] = {}
    met: list[_Piece] = []
    sets: dict[tuple[int, ...], int] = {}
    places: list[tuple[int, int, int]] = []
    own_sets: list[tuple[int, int, int]] = []
    unions = not all(map(_has_lines, kinds))
    for i, text in enumerate(texts):
        if text is None:
            continue
        first = len(places)
        for piece, line in _pieces(text, kept):
            n = number.setdefault(id(piece), len(met))
            if n == len(met):
                met.append(piece)
            places.append((i, n, line))
        if unions:
            own_sets.append((i, sets.setdefault(tuple(n for _, n, _ in places[first:]), len(sets)), 0))
    out = []
    for k, (kind, type_) in enumerate(zip(kinds, types, strict=True)):
        lines = _has_lines(kind)
        groups = [p.rows[k] for p in met] if lines else [sorted(set(chain.from_iterable(met[n].rows[k] for n in own)), key=str) for own in sets]
        whose, of, begins = np.array(places if lines else own_sets, np.int64).reshape(-1, 3).T
        sizes = np.array(list(map(len, groups)), np.int64)
        n = sizes[of]
        take = np.repeat((np.cumsum(sizes) - sizes)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = list(chain.from_iterable(groups))
        columns = [pa.array(c, f.type).take(pa.array(take)) for c, f in zip(zip(*rows, strict=True) if rows else [()] * type_.num_fields, type_, strict=True)]
        if lines and len(take):
            columns[0] = pa.array(columns[0].to_numpy(zero_copy_only=False) + np.repeat(begins, n), pa.int32())
        out.append((np.repeat(whose, n), pa.StructArray.from_arrays(columns, fields=list(type_))))
    return out


def _struct(kind: Kind) -> pa.StructType:
    """A kind's columns but for the file."""
    return pa.struct(list(to_arrow_schema(StructType(StructType.fromDDL(kind[1]).fields[1:]))))


def _table(files: DataFrame, kind: Kind) -> DataFrame:
    """files: file, text. Null texts have no rows."""
    type_ = _struct(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(lambda text: _Piece(text, (kind,)))
        for part in parts:
            [(whose, rows)] = _facts(part.column(1).to_pylist(), (kind,), kept, [type_])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(whose)), *rows.flatten()], ["file", *(f.name for f in type_)])

    return spread(files.selectExpr("cast(file as string) as file", "text")).mapInArrow(run, kind[1])


def tables(files: DataFrame, *kinds: Kind) -> list[DataFrame]:
    """Several tables of the same files, each of which is parsed once: a row a file, with an array a table, is written to the shared folder."""
    types = [_struct(kind) for kind in kinds]
    names = [f"t{i}" for i in range(len(kinds))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Kept(lambda text: _Piece(text, kinds))
        for part in parts:
            found = _facts(part.column(1).to_pylist(), kinds, kept, types)
            counts = [np.bincount(whose, minlength=part.num_rows) for whose, _ in found]
            some = np.flatnonzero(np.sum(counts, axis=0))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n[some]))), pa.int32()), rows) for n, (_, rows) in zip(counts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), *lists], ["file", *names])

    structs = [StructType(StructType.fromDDL(schema).fields[1:]) for _, schema in kinds]
    schema = ", ".join(["file string", *(f"{n} array<{x.simpleString()}>" for n, x in zip(names, structs, strict=True))])
    parsed = Stored(spread(files.selectExpr("cast(file as string) as file", "text")).mapInArrow(run, schema)).frame
    return [parsed.selectExpr("file", f"inline({n})") for n in names]


def use_table(files: DataFrame) -> DataFrame:
    """Every leaf of every use tree."""
    return _table(files, USE_ROWS)


def item_table(files: DataFrame) -> DataFrame:
    """Structs, enums, traits, constants, statics, associated types and constants, and functions with a body, by qualified name."""
    return _table(files, ITEM_ROWS)


def variant_table(files: DataFrame) -> DataFrame:
    return _table(files, VARIANT_ROWS)


def constructed_table(files: DataFrame) -> DataFrame:
    """The last segments of the paths that stand as values in each file."""
    return _table(files, CONSTRUCTED_ROWS)


def path_table(files: DataFrame) -> DataFrame:
    return _table(files, PATH_ROWS)


def error_table(files: DataFrame) -> DataFrame:
    """file, line, name of error types of a package's own."""
    return _table(files, ERROR_ROWS)
