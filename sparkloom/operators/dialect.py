"""The SQL-like log dialect: text -> tokens -> tree -> DataFrame.

SELECT [DISTINCT] items FROM name [WHERE ..] [GROUP BY ..] [HAVING ..] [ORDER BY ..] [LIMIT n] [OFFSET n], with
COUNT SUM AVG MIN MAX, aliases, AND OR NOT, = != <> < <= > >=, IN, BETWEEN, CONTAINS and LIKE. Conditions have two truth
values (see functions.logic). Aggregates follow ANSI SQL. HAVING and ORDER BY know output names and the
aggregates' own spelling. ASC puts nulls last, DESC first.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import logic

KEYWORDS = {"SELECT", "DISTINCT", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "ASC", "DESC", "LIMIT", "OFFSET", "AND", "OR", "NOT", "IN", "BETWEEN", "CONTAINS", "LIKE", "AS", "NULL", "TRUE", "FALSE"}
AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX"}
_TOKEN = re.compile(r"\s+|--[^\n]*|(?P<number>\d+(?:\.\d+)?)|'(?P<text>(?:[^']|'')*)'|(?P<word>[A-Za-z_][A-Za-z_0-9.]*)|(?P<sign><=|>=|!=|<>|[=<>(),*;-])")


class DialectError(ValueError):
    """What is wrong, with line and column from 1."""

    def __init__(self, what: str, text: str, at: int):
        line = text.count("\n", 0, at) + 1
        super().__init__(f"{what} at line {line}, column {at - text.rfind(chr(10), 0, at)}")


class Token(NamedTuple):
    kind: str  # number, text, word, keyword, sign, end
    value: object
    at: int


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DialectError(f"unexpected {text[at]!r}", text, at)
        kind, raw = m.lastgroup, m.group(m.lastgroup) if m.lastgroup else None
        if kind == "number":
            out.append(Token(kind, float(raw) if "." in raw else int(raw), at))
        elif kind == "text":
            out.append(Token(kind, raw.replace("''", "'"), at))
        elif kind == "word":
            out.append(Token("keyword", raw.upper(), at) if raw.upper() in KEYWORDS else Token(kind, raw, at))
        elif kind == "sign":
            out.append(Token(kind, "!=" if raw == "<>" else raw, at))
        at = m.end()
    return [*out, Token("end", None, len(text))]


class Item(NamedTuple):
    function: str | None
    column: str  # * for all
    alias: str | None

    @property
    def label(self) -> str:
        return f"{self.function}({self.column})" if self.function else self.column

    @property
    def name(self) -> str:
        return self.alias or self.label


class Query(NamedTuple):
    items: list[Item]
    distinct: bool
    table: str
    where: tuple | None
    group: list[str]
    having: tuple | None
    order: list[tuple[str, bool]]
    limit: int | None
    offset: int | None


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.i = text, tokens(text), 0

    def fail(self, what: str) -> DialectError:
        t = self.tokens[self.i]
        return DialectError(f"{what}, found {'the end' if t.kind == 'end' else repr(t.value)}", self.text, t.at)

    def take(self, *values: str) -> bool:
        t = self.tokens[self.i]
        if t.kind in ("keyword", "sign") and t.value in values:
            self.i += 1
            return True
        return False

    def need(self, *values: str) -> None:
        for v in values:
            if not self.take(v):
                raise self.fail(f"expected {v}")

    def word(self, what: str) -> str:
        t = self.tokens[self.i]
        if t.kind != "word":
            raise self.fail(f"expected {what}")
        self.i += 1
        return t.value

    def name(self) -> str:
        """A column, or an aggregate by its spelling."""
        word = self.word("a name")
        if word.upper() in AGGREGATES and self.take("("):
            inner = "*" if self.take("*") else self.word("a column")
            self.need(")")
            return f"{word.upper()}({inner})"
        return word

    def literal(self) -> object:
        negative = self.take("-")
        t = self.tokens[self.i]
        if t.kind in ("number", "text") and not (negative and t.kind == "text"):
            self.i += 1
            return -t.value if negative else t.value
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return value
        raise self.fail("expected a value")

    def whole(self, what: str) -> int:
        t = self.tokens[self.i]
        if t.kind != "number" or not isinstance(t.value, int):
            raise self.fail(f"expected a whole number for {what}")
        self.i += 1
        return t.value

    def item(self) -> Item:
        if self.take("*"):
            return Item(None, "*", None)
        label = self.name()
        function, column = (label[: label.index("(")], label[label.index("(") + 1 : -1]) if label.endswith(")") else (None, label)
        alias = self.word("an alias") if self.take("AS") else None
        return Item(function, column, alias)

    def names(self) -> list[str]:
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        return out

    def any_of(self) -> tuple:
        left = self.all_of()
        while self.take("OR"):
            left = ("or", left, self.all_of())
        return left

    def all_of(self) -> tuple:
        left = self.negated()
        while self.take("AND"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.take("NOT"):
            return ("not", self.negated())
        if self.take("("):
            inner = self.any_of()
            self.need(")")
            return inner
        column = self.name()
        negative = self.take("NOT")
        if self.take("IN"):
            self.need("(")
            values = [self.literal()]
            while self.take(","):
                values.append(self.literal())
            self.need(")")
            out = ("in", column, values)
        elif self.take("BETWEEN"):
            low = self.literal()
            self.need("AND")
            out = ("between", column, low, self.literal())
        elif self.take("CONTAINS"):
            out = ("contains", column, str(self.literal()))
        elif self.take("LIKE"):
            out = ("like", column, str(self.literal()))
        else:
            op = next((s for s in ("=", "!=", "<=", ">=", "<", ">") if self.take(s)), None)
            if op is None or negative:
                raise self.fail("expected a comparison")
            out = (op, column, self.literal())
        return ("not", out) if negative else out

    def query(self) -> Query:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("FROM")
        table = self.word("a table")
        where = self.any_of() if self.take("WHERE") else None
        group = having = None
        if self.take("GROUP"):
            self.need("BY")
            group = self.names()
        if self.take("HAVING"):
            having = self.any_of()
        order = []
        if self.take("ORDER"):
            self.need("BY")
            while True:
                order.append((self.name(), not self.take("DESC") or self.take("ASC")))
                self.take("ASC")
                if not self.take(","):
                    break
        limit = self.whole("LIMIT") if self.take("LIMIT") else None
        offset = self.whole("OFFSET") if self.take("OFFSET") else None
        self.take(";")
        if self.tokens[self.i].kind != "end":
            raise self.fail("expected the end")
        return Query(items, distinct, table, where, group or [], having, order, limit, offset)


def parse(text: str) -> Query:
    return _Parser(text).query()


def condition(tree: tuple, column: object = F.col) -> Column:
    op = tree[0]
    if op in ("and", "or"):
        left, right = condition(tree[1], column), condition(tree[2], column)
        return left & right if op == "and" else left | right
    if op == "not":
        return ~condition(tree[1], column)
    c = column(tree[1])
    if op == "in":
        return logic.is_in(c, [v for v in tree[2] if v is not None])
    if op == "between":
        return logic.between(c, tree[2], tree[3])
    if op == "contains":
        return logic.contains(c, tree[2])
    if op == "like":
        return F.coalesce(c.like(tree[2]), F.lit(False))
    return F.lit(False) if tree[2] is None else logic.loose(op, c, tree[2])


def _aggregate(item: Item) -> Column:
    if item.function == "COUNT":
        return F.count(F.lit(1) if item.column == "*" else F.col(item.column))
    c = F.col(item.column)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[item.function](c)


def _spelled(tree: tuple | None) -> set[str]:
    if tree is None:
        return set()
    if tree[0] in ("and", "or", "not"):
        return set().union(*map(_spelled, tree[1:]))
    return {tree[1]}


def run(text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query's result; Catalyst plans it as a whole, so filters and columns reach the scan."""
    q = parse(text)
    if q.table not in tables:
        raise DialectError(f"unknown table {q.table!r}", text, text.find(q.table))
    df = tables[q.table]
    if q.where is not None:
        df = df.where(condition(q.where))
    names = {i.label: i.name for i in q.items} | {i.name: i.name for i in q.items}
    column = lambda n: F.col(f"`{names.get(n, n)}`")
    if q.group or any(i.function for i in q.items):
        wanted = {i.label: i for i in q.items if i.function}
        extra = [n for n in _spelled(q.having) | {n for n, _ in q.order} if n not in names and n.endswith(")")]
        for n in sorted(extra):
            wanted[n] = Item(n[: n.index("(")], n[n.index("(") + 1 : -1], None)
        keys = [F.col(g).alias(next((i.name for i in q.items if not i.function and i.column == g), g)) for g in q.group]
        df = df.groupBy(*keys).agg(*(_aggregate(i).alias(i.name) for i in wanted.values())) if wanted else df.select(*keys).distinct()
        if q.having is not None:
            df = df.where(condition(q.having, column))
        out = [F.col(f"`{i.name}`") for i in q.items]
    else:
        out = []
        for i in q.items:
            out += [F.col(f"`{c}`") for c in df.columns] if i.column == "*" else [F.col(i.column).alias(i.name)]
        if q.having is not None:
            df = df.where(condition(q.having))
    if q.order and not q.distinct:  # before the projection: hidden columns can be sorted by
        by = [column(n) if n in df.columns or names.get(n) in df.columns else F.col(n) for n, _ in q.order]
        aggregated = q.group or any(i.function for i in q.items)
        if not aggregated:
            aliases = {i.name: i.column for i in q.items if i.alias}
            by = [F.col(aliases.get(n, n)) for n, _ in q.order]
        df = df.orderBy(*(c.asc_nulls_last() if up else c.desc_nulls_first() for c, (_, up) in zip(by, q.order, strict=True)))
    df = df.select(*out)
    if q.distinct:
        df = df.distinct()
        if q.order:
            df = df.orderBy(*(column(n).asc_nulls_last() if up else column(n).desc_nulls_first() for n, up in q.order))
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def explain(text: str, tables: dict[str, DataFrame]) -> str:
    return run(text, tables)._jdf.queryExecution().toString()
