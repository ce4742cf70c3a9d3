"""Parser of the traversal language: statements, traversals, steps and literals."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    """A variable."""

    name: str


@dataclass(frozen=True)
class Predicate:
    op: str
    args: tuple


@dataclass(frozen=True)
class Step:
    name: str
    args: tuple


@dataclass(frozen=True)
class Traversal:
    steps: tuple[Step, ...]
    anonymous: bool


@dataclass(frozen=True)
class Script:
    """Statements (name or None, traversal or literal) before the result."""

    statements: tuple[tuple[str | None, object], ...]
    result: Traversal


PREDICATES = ("eq", "neq", "lte", "gte", "between", "within", "regex")
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>-?\d+[LI]?)|(?P<word>[A-Za-z_]\w*)|(?P<op>[().,;=\[\]]))""")
_UUID = re.compile(r"\s*(?:[A-Za-z0-9_]+_)?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")


class QuerySyntaxError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, object]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            if m := _UUID.match(text, at):
                self.tokens.append(("lit", m[0].strip()))
            elif m := _TOKEN.match(text, at):
                kind = m.lastgroup
                raw = m[kind]
                if kind == "str":
                    self.tokens.append(("lit", re.sub(r"\\(.)", r"\1", raw[1:-1])))
                elif kind == "num":
                    self.tokens.append(("lit", int(raw.rstrip("LI"))))
                else:
                    self.tokens.append((kind, raw))
            else:
                raise QuerySyntaxError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, object]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", None)

    def take(self, op: str | None = None) -> object:
        kind, value = self.peek()
        if op is not None and (kind, value) != ("op", op):
            raise QuerySyntaxError(f"expected {op!r}, found {value!r}")
        self.at += 1
        return value

    def script(self) -> Script:
        statements = []
        while True:
            name = None
            if self.peek()[0] == "word" and self.peek(1) == ("op", "="):
                name = self.take()
                self.take("=")
            value = self.value()
            if self.peek() == ("op", ";"):
                self.take(";")
                if name is None and not isinstance(value, Traversal):
                    raise QuerySyntaxError("a bare literal is no statement")
                if self.peek()[0] == "end":
                    raise QuerySyntaxError("a script ends with a traversal")
                statements.append((name, value))
                continue
            if self.peek()[0] != "end" or name is not None or not isinstance(value, Traversal):
                raise QuerySyntaxError("a script ends with a traversal")
            return Script(tuple(statements), value)

    def value(self):
        kind, value = self.peek()
        if kind == "lit":
            return self.take()
        if (kind, value) == ("op", "["):
            self.take("[")
            items = []
            while self.peek() != ("op", "]"):
                items.append(self.value())
                if self.peek() == ("op", ","):
                    self.take(",")
            self.take("]")
            if self.peek() == ("op", ".") and self.peek(1) == ("word", "toArray"):
                self.at += 2
                self.take("(")
                self.take(")")
            return tuple(items)
        if kind != "word":
            raise QuerySyntaxError(f"expected a value, found {value!r}")
        if value == "g" or value in ("_", "__"):
            return self.traversal()
        self.take()
        if self.peek() != ("op", "("):
            return Name(value)
        if value in PREDICATES:
            return Predicate(value, self.arguments())
        self.at -= 1
        return self.steps(())  # a step without "_." begins an anonymous traversal

    def traversal(self) -> Traversal:
        first = self.take()
        if first == "g":
            self.take(".")
            return self.steps((), anonymous=False)
        start = (Step("inject", self.arguments()),) if self.peek() == ("op", "(") else ()
        if self.peek() != ("op", "."):
            return Traversal(start, True)
        self.take(".")
        return self.steps(start)

    def steps(self, begun: tuple[Step, ...], anonymous: bool = True) -> Traversal:
        steps = list(begun)
        while True:
            kind, name = self.peek()
            if kind != "word":
                raise QuerySyntaxError(f"expected a step, found {name!r}")
            self.take()
            steps.append(Step(str(name), self.arguments()))
            if self.peek() != ("op", "."):
                return Traversal(tuple(steps), anonymous)
            self.take(".")

    def arguments(self) -> tuple:
        self.take("(")
        found = []
        while self.peek() != ("op", ")"):
            found.append(self.value())
            if self.peek() == ("op", ","):
                self.take(",")
            elif self.peek() != ("op", ")"):
                raise QuerySyntaxError(f"expected ',' or ')', found {self.peek()[1]!r}")
        self.take(")")
        return tuple(found)


def parse(text: str) -> Script:
    """The syntax tree of a query. String literals keep their white space, and hexadecimal digits of either case make a uuid."""
    return _Parser(text).script()
