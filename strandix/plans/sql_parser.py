"""The SQL dialect: tokens, statements, and a recursive-descent parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from strandix.errors import sql_error

MAX_STATEMENT_BYTES = 65_536
_LEX = re.compile(r"\s*(?:(?P<str>'(?:[^']|'')*')|(?P<num>\d+)|(?P<qid>\"(?:[^\"]|\"\")+\")|(?P<id>[A-Za-z_]\w*)|(?P<op><=|>=|<>|!=|[=<>(),.;?*\-]))", re.A)
_RESERVED = set("SELECT FROM WHERE ORDER BY LIMIT AND OR NOT IS NULL INNER JOIN ON AS WITH EXPLAIN OVER PARTITION VALUES SET".split())


@dataclass(frozen=True)
class Param:
    place: int


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    value: Param | Literal


@dataclass(frozen=True)
class RowCompare:
    columns: tuple[str, ...]
    op: str
    values: tuple


@dataclass(frozen=True)
class IsNull:
    column: str
    negated: bool


@dataclass(frozen=True)
class Not:
    term: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass
class Select:
    columns: list[str] | None
    table: str
    where: object = None
    order: list[str] = field(default_factory=list)
    limit: int | None = None


@dataclass
class Join:
    columns: list[tuple[str, str]]
    left: str
    right: str
    on: list[tuple[tuple[str, str], tuple[str, str]]]
    where: object = None
    order: list[str] = field(default_factory=list)
    limit: int | None = None


@dataclass
class WindowSelect:
    column: str
    function: str
    partition: str | None
    by: str
    alias: str
    table: str
    order: list[str]
    limit: int


@dataclass
class Cte:
    name: str
    inner: Select
    outer: Select


@dataclass
class Explain:
    query: Select | Join


@dataclass
class ColumnDef:
    name: str
    type: str
    nullable: bool = True
    primary: bool = False
    checks: list[tuple[str, object]] = field(default_factory=list)


@dataclass
class ForeignKeyDef:
    name: str | None
    columns: list[str]
    table: str
    target: list[str]


@dataclass
class CreateTable:
    name: str
    columns: list[ColumnDef]
    primary_key: list[str]
    foreign_keys: list[ForeignKeyDef]


@dataclass
class CreateIndex:
    name: str
    table: str
    columns: list[str]
    unique: bool


@dataclass
class DropTable:
    name: str


@dataclass
class DropIndex:
    name: str


@dataclass
class RenameTable:
    name: str
    to: str


@dataclass
class Insert:
    table: str
    columns: list[str]
    values: list


@dataclass
class Update:
    table: str
    assign: list[tuple[str, object]]
    where: list[tuple[str, object]]


@dataclass
class Delete:
    table: str
    where: list[tuple[str, object]]


READ, DATA, CATALOG = "read", "data-mutation", "catalog-mutation"


def statement_class(s) -> str:
    if isinstance(s, (Select, Join, WindowSelect, Cte, Explain)):
        return READ
    return DATA if isinstance(s, (Insert, Update, Delete)) else CATALOG


def lex(text: str) -> list[tuple[str, str]]:
    if len(text.encode()) > MAX_STATEMENT_BYTES:
        raise sql_error(1, "statement too long")
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise sql_error(1, f"at {text[at:at + 20]!r}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


#: Parentheses inside one another in a filter.
MAX_DEPTH = 64


class Parser:
    """Parses one statement; `params` counts its positional parameters."""

    def __init__(self, text: str):
        self.toks, self.at, self.params, self.depth = lex(text), 0, 0, 0

    # -- tokens
    def peek(self, n: int = 0) -> tuple[str, str]:
        return self.toks[self.at + n] if self.at + n < len(self.toks) else ("end", "")

    def is_word(self, *words: str, n: int = 0) -> bool:
        return all(self.peek(n + k)[0] == "id" and self.peek(n + k)[1].upper() == w for k, w in enumerate(words))

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise sql_error(1, f"expected {' '.join(words)} near {self.peek()[1]!r}")

    def op(self, sym: str) -> bool:
        if self.peek() == ("op", sym):
            self.at += 1
            return True
        return False

    def need_op(self, sym: str) -> None:
        if not self.op(sym):
            raise sql_error(1, f"expected {sym} near {self.peek()[1]!r}")

    def name(self) -> str:
        kind, text = self.peek()
        if kind == "id" and text.upper() not in _RESERVED:
            self.at += 1
            return text
        if kind == "qid":
            self.at += 1
            return text[1:-1].replace('""', '"')
        raise sql_error(1, f"expected a name near {text!r}")

    def names(self, parens: bool = False) -> list[str]:
        if parens:
            self.need_op("(")
        out = [self.name()]
        while self.op(","):
            out.append(self.name())
        if parens:
            self.need_op(")")
        return out

    def scalar(self) -> Param | Literal:
        if self.op("?"):
            self.params += 1
            return Param(self.params - 1)
        for w, v in (("NULL", None), ("TRUE", True), ("FALSE", False)):
            if self.word(w):
                return Literal(v)
        minus = self.op("-")
        kind, text = self.peek()
        if kind == "num":
            self.at += 1
            return Literal(-int(text) if minus else int(text))
        if kind == "str" and not minus:
            self.at += 1
            return Literal(text[1:-1].replace("''", "'"))
        raise sql_error(1, f"expected a value near {text!r}")

    # -- predicates
    def filter(self):
        terms = [self.conjunction()]
        while self.word("OR"):
            terms.append(self.conjunction())
        return balanced(Or, terms)

    def conjunction(self):
        terms = [self.negation()]
        while self.word("AND"):
            terms.append(self.negation())
        return balanced(And, terms)

    def negation(self):
        negations = 0
        while self.word("NOT"):
            negations += 1
        if self.peek() == ("op", "(") and self.peek(2) != ("op", ","):
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise sql_error(1, f"parentheses nested over {MAX_DEPTH} deep")
            self.at += 1
            term = self.filter()
            self.need_op(")")
            self.depth -= 1
        else:
            term = self.row_compare() if self.peek() == ("op", "(") else self.predicate()
        # Two negations cancel out in three-valued logic as well.
        return Not(term) if negations % 2 else term

    def comparison(self) -> str:
        for sym in ("=", "<>", "!=", "<=", ">=", "<", ">"):
            if self.op(sym):
                return "<>" if sym == "!=" else sym
        raise sql_error(1, f"expected a comparison near {self.peek()[1]!r}")

    def predicate(self):
        c = self.name()
        if self.word("IS"):
            negated = self.word("NOT")
            self.need("NULL")
            return IsNull(c, negated)
        return Compare(c, self.comparison(), self.scalar())

    def row_compare(self) -> RowCompare:
        cols = self.names(parens=True)
        op = self.comparison()
        self.need_op("(")
        values = [self.scalar()]
        while self.op(","):
            values.append(self.scalar())
        self.need_op(")")
        if len(values) != len(cols):
            raise sql_error(1, "row comparison of different lengths")
        return RowCompare(tuple(cols), op, tuple(values))

    # -- queries
    def tail(self) -> tuple[object, list[str], int | None]:
        where = self.filter() if self.word("WHERE") else None
        order = self.names() if self.word("ORDER", "BY") else []
        return where, order, self.limit()

    def limit(self) -> int | None:
        if not self.word("LIMIT"):
            return None
        kind, text = self.peek()
        if kind != "num":
            raise sql_error(1, "LIMIT needs a number")
        self.at += 1
        return int(text)

    def qualified(self) -> tuple[str, str]:
        t = self.name()
        self.need_op(".")
        return t, self.name()

    def select(self):
        self.need("SELECT")
        if self.op("*"):
            columns: list = None
        else:
            columns = [self.item()]
            while self.op(","):
                if len(columns) == 1 and (self.is_word("ROW_NUMBER") or self.is_word("RANK")) and self.peek(1) == ("op", "("):
                    return self.window(columns[0])
                columns.append(self.item())
        self.need("FROM")
        table = self.name()
        if self.word("INNER", "JOIN"):
            right = self.name()
            self.need("ON")
            on = [self.join_term()]
            while self.word("AND"):
                on.append(self.join_term())
            if columns is None or not all(isinstance(c, tuple) for c in columns):
                raise sql_error(1, "a join needs qualified columns")
            return Join(columns, table, right, on, *self.tail())
        if columns and any(isinstance(c, tuple) for c in columns):
            raise sql_error(1, "qualified columns outside a join")
        return Select(columns, table, *self.tail())

    def item(self):
        return self.qualified() if self.peek(1) == ("op", ".") else self.name()

    def join_term(self):
        a = self.qualified()
        self.need_op("=")
        return a, self.qualified()

    def window(self, column) -> WindowSelect:
        function = self.name().upper()
        self.need_op("(")
        self.need_op(")")
        self.need("OVER")
        self.need_op("(")
        partition = self.name() if self.word("PARTITION", "BY") else None
        self.need("ORDER", "BY")
        by = self.name()
        self.need_op(")")
        self.need("AS")
        alias = self.name()
        self.need("FROM")
        table = self.name()
        self.need("ORDER", "BY")
        order = self.names()
        limit = self.limit()
        if limit is None or isinstance(column, tuple):
            raise sql_error(1, "a window query needs one plain column and LIMIT")
        return WindowSelect(column, function, partition, by, alias, table, order, limit)

    # -- definitions and changes
    def create(self):
        if self.word("TABLE"):
            name = self.name()
            self.need_op("(")
            columns, key, foreign = [], [], []
            while True:
                if self.word("PRIMARY", "KEY"):
                    if key:
                        raise sql_error(1, "two primary keys")
                    key = self.names(parens=True)
                elif self.is_word("CONSTRAINT") or self.is_word("FOREIGN", "KEY"):
                    label = self.name() if self.word("CONSTRAINT") else None
                    self.need("FOREIGN", "KEY")
                    cols = self.names(parens=True)
                    self.need("REFERENCES")
                    foreign.append(ForeignKeyDef(label, cols, self.name(), self.names(parens=True)))
                else:
                    columns.append(self.column())
                if not self.op(","):
                    break
            self.need_op(")")
            inline = [c.name for c in columns if c.primary]
            if len(inline) > 1 or (inline and key) or not (inline or key):
                raise sql_error(1, "exactly one primary key is needed")
            return CreateTable(name, columns, key or inline, foreign)
        unique = self.word("UNIQUE")
        self.need("INDEX")
        name = self.name()
        self.need("ON")
        return CreateIndex(name, self.name(), self.names(parens=True), unique)

    def column(self) -> ColumnDef:
        name, kind = self.name(), self.name()
        if kind.upper() == "DOUBLE" and self.word("PRECISION"):
            kind = "DOUBLE PRECISION"
        if self.op("("):
            kind += f"({self.integer()},"
            self.need_op(",")
            kind += f"{self.integer()})"
            self.need_op(")")
        c = ColumnDef(name, kind)
        while True:
            if self.word("NOT", "NULL"):
                c.nullable = False
            elif self.word("NULL"):
                c.nullable = True
            elif self.word("PRIMARY", "KEY"):
                c.primary, c.nullable = True, False
            elif self.word("CHECK"):
                self.need_op("(")
                if self.name().lower() != name.lower():
                    raise sql_error(1, "a check may name its own column only")
                op = self.comparison()
                value = self.scalar()
                if isinstance(value, Param):
                    raise sql_error(1, "a check needs a literal")
                c.checks.append((op, value.value))
                self.need_op(")")
            else:
                return c

    def integer(self) -> int:
        kind, text = self.peek()
        if kind != "num":
            raise sql_error(1, "expected a number")
        self.at += 1
        return int(text)

    def equalities(self) -> list[tuple[str, object]]:
        out = []
        while True:
            c = self.name()
            self.need_op("=")
            out.append((c, self.scalar()))
            if not self.word("AND"):
                return out

    def statement(self):
        s = self._statement()
        self.op(";")
        if self.peek()[0] != "end":
            raise sql_error(1, f"unexpected {self.peek()[1]!r}")
        if isinstance(s, (Select, Join)) and not isinstance(s, Cte):
            check_limit(s)
        return s

    def _statement(self):
        if self.word("EXPLAIN"):
            q = self.select()
            if isinstance(q, WindowSelect):
                raise sql_error(1, "EXPLAIN takes a plain query or a join")
            check_limit(q)
            return Explain(q)
        if self.is_word("SELECT"):
            return self.select()
        if self.word("WITH"):
            name = self.name()
            self.need("AS")
            self.need_op("(")
            inner = self.select()
            self.need_op(")")
            outer = self.select()
            if not isinstance(inner, Select) or not isinstance(outer, Select):
                raise sql_error(1, "a common table expression takes plain queries")
            check_limit(inner)
            if outer.where is not None or outer.order or outer.limit is None or outer.table.lower() != name.lower():
                raise sql_error(1, "the outer query may project and limit only")
            return Cte(name, inner, outer)
        if self.word("CREATE"):
            return self.create()
        if self.word("ALTER", "TABLE"):
            name = self.name()
            self.need("RENAME", "TO")
            return RenameTable(name, self.name())
        if self.word("DROP", "TABLE"):
            return DropTable(self.name())
        if self.word("DROP", "INDEX"):
            return DropIndex(self.name())
        if self.word("INSERT", "INTO"):
            table, columns = self.name(), self.names(parens=True)
            self.need("VALUES")
            self.need_op("(")
            values = [self.scalar()]
            while self.op(","):
                values.append(self.scalar())
            self.need_op(")")
            if len(values) != len(columns):
                raise sql_error(1, "as many values as columns are needed")
            return Insert(table, columns, values)
        if self.word("UPDATE"):
            table = self.name()
            self.need("SET")
            assign = []
            while True:
                c = self.name()
                self.need_op("=")
                assign.append((c, self.scalar()))
                if not self.op(","):
                    break
            self.need("WHERE")
            return Update(table, assign, self.equalities())
        if self.word("DELETE", "FROM"):
            table = self.name()
            self.need("WHERE")
            return Delete(table, self.equalities())
        raise sql_error(1, f"near {self.peek()[1]!r}")


def balanced(kind, terms: list):
    """The terms joined by And or Or as a tree of little depth; both are associative."""
    if len(terms) == 1:
        return terms[0]
    mid = len(terms) // 2
    return kind(balanced(kind, terms[:mid]), balanced(kind, terms[mid:]))


def conjuncts(f) -> list:
    """The terms that a filter joins by AND at its top."""
    return [] if f is None else conjuncts(f.left) + conjuncts(f.right) if isinstance(f, And) else [f]


def check_limit(q: Select | Join) -> None:
    """Without a scalar equality at the top of its filter, a query needs LIMIT."""
    if q.limit is None and not any(isinstance(t, Compare) and t.op == "=" for t in conjuncts(q.where)):
        raise sql_error(1, "LIMIT is needed")


def parse(text: str):
    """(statement, number of its parameters)."""
    p = Parser(text)
    s = p.statement()
    return s, p.params
