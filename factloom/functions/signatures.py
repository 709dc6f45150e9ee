"""Facts about functions' signatures and bodies, for rules on patterns: parameters and their types, which of them guards check together, input and output, acquiring and
releasing calls; and structs with their public fields.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from .items import Facts, Kind, Node, _is, _macro_input, _table, _type_name

#: Types whose values often stand for something of the domain.
PRIMITIVES = ("u8", "u16", "u32", "u64", "usize", "i8", "i16", "i32", "i64", "isize", "f32", "f64", "String", "&str")
#: Calls into these, and methods of these names, are input or output.
IO_PATHS = (("std", "fs"), ("std", "env"), ("std", "process"), ("std", "io"))
IO_METHODS = ("read_to_string", "read_to_end", "write_all", "read_line", "flush")
#: Macros that write to the terminal, those that do if what they are given names a stream, and the streams.
OUTPUT_MACROS = ("println", "eprintln", "print", "eprint")
WRITE_MACROS = ("write", "writeln")
STREAMS = ("stdout", "stderr", "Stdout", "Stderr")
#: Calls that take a resource, and those that give it back.
ACQUIRE = ("register", "acquire", "open", "lock", "begin", "start", "connect", "subscribe")
RELEASE = ("unregister", "release", "close", "unlock", "end", "stop", "disconnect", "unsubscribe")


def _walk(nodes: list[Node], macros: bool = False) -> Iterator[tuple[list[Node], int]]:
    """Every list of nodes and place in it, but for what macros are given unless asked for."""
    todo = [nodes]
    while todo:
        level = todo.pop()
        for at, n in enumerate(level):
            yield level, at
            if n.inner is not None and (macros or not _macro_input(level, at)):
                todo.append(n.inner)


def _macro(level: list[Node], at: int) -> bool:
    return level[at].is_name and _is(level, at + 1, "!") and at + 2 < len(level) and level[at + 2].inner is not None


def _names(nodes: list[Node]) -> set[str]:
    """Names that stand alone, not as a part of a path, a field or a method, outside macros' input."""
    out, todo = set(), [nodes]
    while todo:
        level = todo.pop()
        for at, n in enumerate(level):
            if n.inner is not None:
                if not _macro_input(level, at):
                    todo.append(n.inner)
            elif n.is_name and not (at and level[at - 1].inner is None and level[at - 1].text in (".", ":")) and not _is(level, at + 1, ":", ":") and not _is(level, at + 1, "!"):
                out.add(n.text)
    return out


def _all_names(nodes: list[Node]) -> set[str]:
    """Names anywhere, as a macro's input is searched."""
    return {level[at].text for level, at in _walk(nodes, macros=True) if level[at].is_name}


def _fails(nodes: list[Node]) -> bool:
    """Whether a block returns Err(...) or panics somewhere."""
    for level, at in _walk(nodes):
        if _is(level, at, "panic", "!"):
            return True
        if _is(level, at, "return"):
            end = at + 1
            while end < len(level) and level[end].inner is None and (level[end].is_name or level[end].text == ":"):
                end += 1
            if end < len(level) and level[end].is_group("(") and level[end - 1].text == "Err":
                return True
    return False


class Signature:
    """params (name and type of each plain one), returns, checked (sets of names that an assert or an if with a failing branch looks at), conditions (sets of names of every if and match),
    io, output, acquires, releases."""

    def __init__(self, nodes: list[Node]) -> None:
        body = nodes[-1].inner or []
        place = next((i for i, n in enumerate(nodes) if n.is_group("(")), None)
        self.params = list(self._params(nodes[place].inner)) if place is not None else []
        back = nodes[place + 1 : -1] if place is not None else []
        self.returns = self._type(back[2:]) if _is(back, 0, "-", ">") else None
        self.returned = self._returned(back[2:]) if _is(back, 0, "-", ">") else None
        self.checked: list[set[str]] = []
        self.conditions: list[set[str]] = []
        self.io = self.output = self.acquires = self.releases = False
        for level, at in _walk(body):
            n = level[at]
            if not n.is_name:
                continue
            if n.text in ("if", "match"):
                end = next((i for i in range(at + 1, len(level)) if level[i].is_group("{")), len(level))
                names = _names(level[at + 1 : end])
                self.conditions.append(names)
                if n.text == "if" and end < len(level) and _fails(level[end].inner):
                    self.checked.append(names)
            elif _macro(level, at) and not _is(level, at - 1, ":"):
                inner = level[at + 2].inner
                if n.text == "assert":
                    self.checked.append(_all_names(inner))
                self.output |= n.text in OUTPUT_MACROS or (n.text in WRITE_MACROS and any(s in w for w in _all_names(inner) for s in STREAMS))
            elif at + 1 < len(level) and level[at + 1].is_group("("):
                method = at > 0 and _is(level, at - 1, ".")
                self.acquires |= n.text in ACQUIRE
                self.releases |= n.text in RELEASE
                if method:
                    self.io |= n.text in IO_METHODS
                else:
                    first = at
                    while first >= 3 and _is(level, first - 2, ":", ":") and level[first - 3].is_name:
                        first -= 3
                    parts = [m.text for m in level[first : at + 1] if m.is_name]
                    self.io |= any((a, b) in IO_PATHS for a, b in zip(parts, parts[1:], strict=False))

    @staticmethod
    def _type(nodes: list[Node]) -> str:
        """A type as one text without spaces, up to a where."""
        if len(nodes) == 1 and nodes[0].inner is None:
            return "" if nodes[0].text == "where" else nodes[0].text
        out = []
        for n in nodes:
            if n.inner is None and n.text == "where":
                break
            out.append(n.text + Signature._type(n.inner) + {"(": ")", "[": "]", "{": "}"}[n.text] if n.inner is not None else n.text)
        return "".join(out)

    @staticmethod
    def _returned(nodes: list[Node]) -> str | None:
        """The name of the type that comes back, or of the first of a Result."""
        name = _type_name(nodes)
        if name == "Result":
            begin = next((i for i, n in enumerate(nodes) if n.inner is None and n.text == "<"), None)
            if begin is not None:
                depth, end = 1, begin + 1
                while end < len(nodes) and depth:
                    depth += (nodes[end].text == "<") - (nodes[end].text == ">" and not _is(nodes, end - 1, "-"))
                    if depth == 1 and nodes[end].inner is None and nodes[end].text == ",":
                        break
                    end += 1
                return Signature._returned([n for n in nodes[begin + 1 : end] if n.text != ">"] if depth == 0 else nodes[begin + 1 : end])
        return None if name == "?" else name

    @staticmethod
    def _params(nodes: list[Node]) -> Iterator[tuple[str, str]]:
        begin, depth, ends = 0, 0, []
        for at, n in enumerate(nodes):
            text = n.text
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= not _is(nodes, at - 1, "-")
            elif text == "," and not depth:
                ends.append(at)
        for at in (*ends, len(nodes)):
            begin += _is(nodes, begin, "mut")
            if at - begin > 2 and nodes[begin].is_name and nodes[begin + 1].text == ":" and nodes[begin + 2].text != ":":
                yield nodes[begin].text, Signature._type(nodes[begin + 2 : at])
            begin = at + 1


def _functions(f: Facts) -> Iterator[tuple]:
    for line, name, owner, public, nodes, *_ in f.functions:
        s = Signature(nodes)
        own = {p for p, _ in s.params}
        returned = owner if s.returned == "Self" else s.returned
        checked = [sorted(c & own) for c in s.checked if c & own]
        yield line, name, public, [{"name": p, "type": t} for p, t in s.params], returned, checked, [sorted(c & own) for c in s.conditions if c & own], s.io, s.output, s.acquires, s.releases


def _structs(f: Facts) -> Iterator[tuple]:
    for line, name, public, attributes, nodes in f.structs:
        closed = any(a.inner and a.inner[0].text == "non_exhaustive" for a in attributes)
        yield line, name, public, closed, [nodes[i + 1].text for i in range(len(nodes) - 2) if _is(nodes, i, "pub") and nodes[i + 1].is_name and _is(nodes, i + 2, ":")]


FUNCTIONS = (
    "file string, line int, name string, public boolean, params array<struct<name: string, type: string>>, returned string, checked array<array<string>>, conditions array<array<string>>, "
    "io boolean, output boolean, acquires boolean, releases boolean"
)
STRUCTS = "file string, line int, name string, public boolean, non_exhaustive boolean, fields array<string>"
FUNCTION_ROWS: Kind = (_functions, FUNCTIONS)
STRUCT_ROWS: Kind = (_structs, STRUCTS)
DROP_ROWS: Kind = (lambda f: [(True,)] if f.drops else [], "file string, drops boolean")


def signature_table(files: DataFrame) -> DataFrame:
    """A row a function with a body. checked: the parameters that each assert, and each if with a failing branch, looks at; conditions: those of every if and match.
    returned: the name of the type that comes back, alone or first in a Result, Self told by its impl."""
    return _table(files, FUNCTION_ROWS)


def struct_table(files: DataFrame) -> DataFrame:
    """A row a struct with named fields: the public ones."""
    return _table(files, STRUCT_ROWS)


def drop_table(files: DataFrame) -> DataFrame:
    """file of those that implement Drop."""
    return _table(files, DROP_ROWS).select("file")


def _exposed(f: Facts) -> Iterator[tuple]:
    for line, name, _, public, nodes, *_ in f.functions:
        if public:
            found = set()
            for level, at in _walk(nodes[:-1]):
                if _is(level, at, "crate", ":", ":") and not _is(level, at - 1, ":"):
                    parts, i = [], at + 3
                    while i < len(level) and level[i].is_name:
                        parts.append(level[i].text)
                        if not _is(level, i + 1, ":", ":"):
                            break
                        i += 3
                    found.add("::".join(parts))
            yield from ((line, name, path) for path in sorted(found - {""}))


def exposed_table(files: DataFrame) -> DataFrame:
    """file, line, name, path: what public functions name of their own package, by paths from its root, in parameters and what they give back."""
    return _table(files, (_exposed, "file string, line int, name string, path string"))
