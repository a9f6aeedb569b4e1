"""Lexer and recursive-descent parser of the graph query language."""

from __future__ import annotations

import re
from functools import lru_cache

from lodestone.errors import ParseError
from lodestone.plans import ast as A

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)|(?P<int>\d+)
    |(?P<str>"[^"]*"|'[^']*')|(?P<param>\$[A-Za-z_][A-Za-z0-9_]*)|(?P<name>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><>|<=|>=|!=|->|<-|\.\.|[-+*/%=<>(){}\[\],.:;|])""",
    re.X | re.S,
)
NOT_ALIAS = {"FROM", "WHERE", "RETURN", "ORDER", "LIMIT", "SKIP", "OFFSET", "UNION", "AS"}


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m[0], m.start(), m.end()))
            at = m.end()
        self.tokens.append(("end", "", len(text), len(text)))
        self.i = 0

    # -- tokens ---------------------------------------------------------------------------------
    def peek(self, k: int = 0):
        return self.tokens[min(self.i + k, len(self.tokens) - 1)]

    def fail(self, wanted: str):
        kind, value, at, _ = self.peek()
        raise ParseError(f"expected {wanted} at {at}, found {value or kind!r}")

    def is_op(self, *ops: str, k: int = 0) -> bool:
        t = self.peek(k)
        return t[0] == "op" and t[1] in ops

    def is_word(self, *words: str, k: int = 0) -> bool:
        t = self.peek(k)
        return t[0] == "name" and t[1].upper() in words

    def op(self, *ops: str) -> str | None:
        if self.is_op(*ops):
            self.i += 1
            return self.tokens[self.i - 1][1]
        return None

    def word(self, *words: str) -> str | None:
        if self.is_word(*words):
            self.i += 1
            return self.tokens[self.i - 1][1].upper()
        return None

    def need_op(self, op: str) -> None:
        if not self.op(op):
            self.fail(f"'{op}'")

    def need_word(self, *words: str) -> str:
        return self.word(*words) or self.fail(" or ".join(words))

    def name(self) -> str:
        if self.peek()[0] != "name":
            self.fail("a name")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def string(self) -> str:
        if self.peek()[0] != "str":
            self.fail("a string")
        self.i += 1
        return self.tokens[self.i - 1][1][1:-1]

    # -- statements -----------------------------------------------------------------------------
    def statement(self):
        parts, every = [self.single()], False
        while self.word("UNION"):
            every = bool(self.word("ALL")) or every
            parts.append(self.single())
        self.op(";")
        if self.peek()[0] != "end":
            self.fail("the end of the statement")
        return parts[0] if len(parts) == 1 else A.Union(parts, every)

    def single(self):
        if self.is_word("OPTIONAL"):
            return self.optional_statement()
        if self.is_word("MATCH"):
            return self.match_statement()
        if self.is_word("UNWIND"):
            return self.unwind_statement()
        if self.is_word("CALL"):
            return self.call_statement()
        if self.word("INSERT"):
            return A.Insert(self.insert_elements())
        if self.is_word("DELETE", "DETACH"):
            return self.legacy_delete()
        if self.word("TRUNCATE"):
            return A.Admin("TRUNCATE")
        if self.is_word("CREATE", "DROP"):
            return self.definition()
        if self.word("SHOW"):
            kind = self.need_word("INDEXES", "INDICES", "CONSTRAINTS")
            return A.Admin("SHOW CONSTRAINTS" if kind == "CONSTRAINTS" else "SHOW INDEXES")
        if self.word("LOAD"):
            self.need_word("CSV")
            kind = self.need_word("NODES", "EDGES")
            self.need_word("FROM")
            path = self.string()
            return A.Admin(f"LOAD {kind}", self.name() if self.word("LABEL") else None, extra=path)
        return self.fail("a statement")

    def definition(self):
        verb = self.need_word("CREATE", "DROP")
        kind, extra = self.need_word("INDEX", "CONSTRAINT"), None
        if kind == "CONSTRAINT":
            if self.word("UNIQUE"):
                extra = "UNIQUE"
            else:
                self.need_word("TYPE")
                self.need_word("IS")
                extra = self.need_word("INTEGER", "FLOAT", "STRING", "BOOLEAN")
        self.need_word("ON")
        self.need_op(":")
        label = self.name()
        self.need_op("(")
        prop = self.name()
        self.need_op(")")
        return A.Admin(f"{verb} {kind}", label, prop, extra)

    def where(self):
        return self.expr() if self.word("WHERE") else None

    def mode(self) -> str:
        if self.is_word("WALK", "TRAIL", "SIMPLE") and self.is_op("(", k=1):
            return self.word("WALK", "TRAIL", "SIMPLE")
        return "WALK"

    def match_statement(self):
        self.need_word("MATCH")
        q = A.Query(mode=self.mode())
        q.patterns = self.patterns()
        q.where = self.where()
        if self.word("INSERT"):
            return A.Insert(self.insert_elements(), q.patterns, q.where)
        if self.is_word("SET", "REMOVE", "DELETE", "DETACH"):
            return self.update(q)
        while self.word("OPTIONAL"):
            self.need_word("MATCH")
            patterns = self.patterns()
            q.optionals.append(A.Optional(patterns, self.where()))
        if self.word("WITH"):
            distinct = bool(self.word("DISTINCT"))
            star, items = self.items()
            q.with_ = A.With(items, distinct, self.where(), star)
        q.returns = self.returns()
        return q

    def optional_statement(self):
        self.need_word("OPTIONAL")
        self.need_word("MATCH")
        q = A.Query(mode=self.mode(), optional_only=True)
        q.patterns = self.patterns()
        q.where = self.where()
        q.returns = self.returns()
        return q

    def unwind_statement(self):
        self.need_word("UNWIND")
        expr = self.expr()
        self.need_word("AS")
        unwind = (expr, self.name())
        if self.word("INSERT"):
            return A.Insert(self.insert_elements(), unwind=unwind)
        return A.Query(unwind=unwind, returns=self.returns())

    def call_statement(self):
        self.need_word("CALL")
        name, args = self.name(), {}
        self.need_op("(")
        while not self.is_op(")"):
            key = self.name()
            self.need_op(":")
            args[key] = self.expr()
            if not self.op(","):
                break
        self.need_op(")")
        yields = None
        if self.word("YIELD"):
            yields = [self.name()]
            while self.op(","):
                yields.append(self.name())
        q = A.Query(call=A.CallStmt(name, args, yields))
        if self.word("MATCH"):
            q.mode = self.mode()
            q.patterns = self.patterns()
            q.where = self.where()
        if self.is_word("RETURN"):
            q.returns = self.returns()
        elif q.patterns:
            self.fail("RETURN")
        return q

    def update(self, q):
        if len(q.patterns) != 1:
            raise ParseError("SET, REMOVE and DELETE take one pattern")
        detach = bool(self.word("DETACH"))
        kind = self.need_word("SET", "REMOVE", "DELETE")
        out = A.Update(kind, q.patterns, q.where, detach=detach)
        while True:
            var = self.name()
            if kind == "DELETE":
                out.variables.append(var)
            elif self.op(":"):
                out.labels.append((var, self.name()))
            else:
                self.need_op(".")
                prop, value = self.name(), None
                if kind == "SET":
                    self.need_op("=")
                    value = self.expr()
                out.props.append((var, prop, value))
            if not self.op(","):
                return out

    def legacy_delete(self):
        detach = bool(self.word("DETACH"))
        self.need_word("DELETE")
        self.need_word("MATCH")
        pattern = self.pattern()
        where = self.where()
        found = [n.var for n in (pattern.start, *(n for _, n in pattern.steps)) if n.var] + [e.var for e, _ in pattern.steps if e.var]
        if self.word("RETURN") or not found:
            self.fail("a pattern with variables")
        return A.Update("DELETE", [pattern], where, variables=found, detach=detach)

    # -- patterns -------------------------------------------------------------------------------
    def patterns(self):
        out = [self.pattern()]
        while self.op(","):
            out.append(self.pattern())
        return out

    def pattern(self):
        p = A.Pattern(self.node())
        while self.is_op("-", "<-", "->"):
            edge = self.edge()
            p.steps.append((edge, self.node()))
        return p

    def props(self):
        out = []
        if self.op("{"):
            while not self.is_op("}"):
                key = self.name()
                self.need_op(":")
                out.append((key, self.expr()))
                if not self.op(","):
                    break
            self.need_op("}")
        return out

    def node(self):
        self.need_op("(")
        var = self.name() if self.peek()[0] == "name" else None
        labels = []
        while self.op(":"):
            labels.append(self.name())
        props = self.props()
        self.need_op(")")
        return A.NodePattern(var, labels, props)

    def edge(self):
        e = A.EdgePattern(None, None, [], "any")
        if self.op("->"):
            e.direction = "out"
            return e
        left = bool(self.op("<-"))
        if not left:
            self.need_op("-")
        if not self.op("["):
            e.direction = "in" if left else "any"
            return e
        if self.peek()[0] == "name":
            e.var = self.name()
        if self.op(":"):
            e.label = self.name()
        e.quantifier = self.quantifier()
        if not e.quantifier:
            e.props = self.props()
            e.quantifier = self.quantifier()
        self.need_op("]")
        right = not left and bool(self.op("->"))
        if not right:
            self.need_op("-")
        e.direction = "in" if left else "out" if right else "any"
        return e

    def is_quantifier(self):
        return self.is_op("{") and self.peek(1)[0] in ("int", "float")

    def quantifier(self):
        if self.op("+"):
            return (1, None)
        if self.is_quantifier():
            self.need_op("{")
            low, high = self.bounds(",")
            self.need_op("}")
            return (low, high)
        if self.op("*"):
            if self.peek()[0] in ("int", "float") or self.is_op(".."):
                return self.bounds("..")
            return (0, None)
        return None

    def bounds(self, sep):
        low = self.integer() if self.peek()[0] == "int" else 0
        if not self.op(sep):
            return low, low
        high = self.integer() if self.peek()[0] == "int" else None
        if high is not None and high < low:
            raise ParseError("the quantifier's upper bound is below its lower bound")
        return low, high

    def integer(self):
        self.i += 1
        return int(self.tokens[self.i - 1][1])

    def insert_elements(self):
        return self.patterns()

    # -- returns --------------------------------------------------------------------------------
    def items(self):
        if self.op("*"):
            return True, []
        out = [self.item()]
        while self.op(","):
            out.append(self.item())
        return False, out

    def item(self):
        start = self.peek()[2]
        expr = self.expr()
        text = self.text[start : self.tokens[self.i - 1][3]]
        alias = self.name() if self.word("AS") else None
        return A.Item(expr, alias, text)

    def returns(self):
        self.need_word("RETURN")
        r = A.Return([])
        r.distinct = bool(self.word("DISTINCT"))
        r.star, r.items = self.items()
        while True:
            if self.word("ORDER"):
                self.need_word("BY")
                while True:
                    e = self.expr()
                    down = self.word("ASC", "DESC") == "DESC"
                    r.order.append((e, not down))
                    if not self.op(","):
                        break
            elif self.word("LIMIT"):
                r.limit = self.additive()
            elif self.word("OFFSET", "SKIP"):
                r.offset = self.additive()
            else:
                return r

    # -- expressions: OR < AND < NOT < comparison < + - < * / % < unary minus ----------------------
    def expr(self):
        left = self.and_()
        while self.word("OR"):
            left = A.Bin("OR", left, self.and_())
        return left

    def and_(self):
        left = self.not_()
        while self.word("AND"):
            left = A.Bin("AND", left, self.not_())
        return left

    def not_(self):
        return A.Not(self.not_()) if self.word("NOT") else self.comparison()

    def comparison(self):
        left = self.additive()
        if self.word("IS"):
            negated = bool(self.word("NOT"))
            self.need_word("NULL")
            return A.IsNull(left, negated)
        if self.word("IN"):
            return A.Bin("IN", left, self.additive())
        op = self.op("=", "<>", "!=", "<=", ">=", "<", ">")
        if op is None and self.is_op("<-"):  # a < -b
            self.i += 1
            return A.Bin("<", left, A.Bin("-", A.Lit(0), self.unary()))
        return A.Bin("<>" if op == "!=" else op, left, self.additive()) if op else left

    def additive(self):
        left = self.multiplicative()
        while op := self.op("+", "-"):
            left = A.Bin(op, left, self.multiplicative())
        return left

    def multiplicative(self):
        left = self.unary()
        while op := self.op("*", "/", "%"):
            left = A.Bin(op, left, self.unary())
        return left

    def unary(self):
        if self.op("-"):
            arg = self.unary()
            return A.Lit(-arg.value) if isinstance(arg, A.Lit) and isinstance(arg.value, (int, float)) else A.Bin("-", A.Lit(0), arg)
        return self.primary()

    def primary(self):
        kind, value, _, _ = self.peek()
        if kind == "int":
            self.i += 1
            return A.Lit(int(value))
        if kind == "float":
            self.i += 1
            return A.Lit(float(value))
        if kind == "str":
            return A.Lit(self.string())
        if kind == "param":
            self.i += 1
            return A.Param(value[1:])
        if self.op("("):
            e = self.expr()
            self.need_op(")")
            return e
        if self.op("["):
            items = []
            while not self.is_op("]"):
                items.append(self.expr())
                if not self.op(","):
                    break
            self.need_op("]")
            return A.ListExpr(tuple(items))
        if kind != "name":
            self.fail("an expression")
        if value.upper() in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return A.Lit({"TRUE": True, "FALSE": False, "NULL": None}[value.upper()])
        name = self.name()
        if self.op("("):
            if self.op("*"):
                self.need_op(")")
                return A.Call(name.lower(), (), star=True)
            distinct, args = bool(self.word("DISTINCT")), []
            while not self.is_op(")"):
                args.append(self.expr())
                if not self.op(","):
                    break
            self.need_op(")")
            return A.Call(name.lower(), tuple(args), distinct)
        if self.op("."):
            return A.Prop(name, self.name())
        return A.Var(name)


@lru_cache(maxsize=512)
def parse(text: str):
    """The statement of ``text``; ParseError if it isn't one. Callers don't change the result."""
    return _Parser(text).statement()
