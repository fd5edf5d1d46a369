"""The textual query language: text -> statements -> DataFrames. The whole input must parse; errors name the place."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph import schemas
from rillgraph.operators import histogram, sequential, topk, transform, windows
from rillgraph.plans.pattern import Pattern, match

TOKEN = re.compile(r"\s+|(?P<number>\d+(?:\.\d+)?)|(?P<name>[^\W\d]\w*)|(?P<string>\"[^\"]*\")|(?P<op><=|>=|==|!=|[-+*/<>=(){},;:.])")


class SyntaxFault(ValueError):
    pass


@dataclass
class Statement:
    kind: str
    name: str = ""
    args: dict = field(default_factory=dict)


class Parser:
    """Recursive descent. Keywords are case-insensitive; U+2212 is a minus."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text.replace("−", "-"), [], 0
        while at < len(self.text):
            m = TOKEN.match(self.text, at)
            if not m:
                self._fail(at, "unexpected character")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens.append(("end", "", at))
        self.i = 0

    def _fail(self, at: int, what: str):
        line = self.text.count("\n", 0, at) + 1
        raise SyntaxFault(f"line {line}, column {at - self.text.rfind(chr(10), 0, at)}: {what}, found {self.text[at : at + 20]!r}")

    def peek(self, *values: str, ahead: int = 0) -> bool:
        t = self.tokens[min(self.i + ahead, len(self.tokens) - 1)]
        return t[0] != "string" and t[1].upper() in [v.upper() for v in values]

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        t = self.tokens[self.i]
        if value is not None and not self.peek(value) or kind is not None and t[0] != kind:
            self._fail(t[2], f"expected {value or kind}")
        self.i += 1
        return t[1]

    def maybe(self, value: str) -> bool:
        if self.peek(value):
            self.i += 1
            return True
        return False

    def names(self) -> list[str]:
        out = [self.take(kind="name")]
        while self.maybe(","):
            out.append(self.take(kind="name"))
        return out

    def program(self) -> list[Statement]:
        out = []
        while self.tokens[self.i][0] != "end":
            out.append(self.statement())
            while self.maybe(";"):
                pass
        return out

    def statement(self) -> Statement:
        if self.maybe("PARTITION"):
            s = self.take(kind="name")
            self.take("BY")
            return Statement("partition", s, {"fields": self.names()})
        if self.maybe("HASH"):
            f = self.take(kind="name")
            self.take("WITH")
            return Statement("hash", f, {"fn": self.take(kind="name")})
        if self.maybe("SUBGRAPH"):
            return self.subgraph()
        name = self.take(kind="name")
        self.take("=")
        if self.tokens[self.i][0] == "number":
            return Statement("set", name, {"value": int(self.take(kind="number"))})
        if self.maybe("STREAM"):
            s = self.take(kind="name")
            self.take("BY")
            return Statement("stream", name, {"of": s, "keys": self.names()})
        if self.maybe("FILTER"):
            s = self.take(kind="name")
            self.take("BY")
            return Statement("filter", name, {"of": s, "by": self.expression()})
        if self.maybe("COLLAPSE"):
            s = self.take(kind="name")
            self.take("BY")
            keys = self.names()
            self.take("FOR")
            return Statement("collapse", name, {"of": s, "keys": keys, "features": self.names()})
        if self.maybe("FOREACH"):
            s = self.take(kind="name")
            if self.maybe("TRANSFORM"):
                e = self.expression()
                self.take(":")
                return Statement("transform", name, {"of": s, "expression": e, "as": self.take(kind="name")})
            self.take("GENERATE")
            op = self.take(kind="name")
            self.take("(")
            args = [self.expression()]
            while self.maybe(","):
                args.append(self.expression())
            self.take(")")
            return Statement("generate", name, {"of": s, "op": op.lower(), "args": args})
        kind = self.take(kind="name")
        self.take("(")
        where = self.take(kind="string")[1:-1]
        self.take(",")
        port = int(self.take(kind="number"))
        self.take(")")
        return Statement("connect", name, {"type": kind, "host": where, "port": port})

    def subgraph(self) -> Statement:
        self.take("ON")
        s = self.take(kind="name")
        self.take("WITH")
        ends = {}
        for k, end in enumerate(("source", "target")):
            if k:
                self.take("AND")
            self.take(end)
            self.take("(")
            ends[end] = self.take(kind="name")
            self.take(")")
        self.take("{")
        edges, members, conditions = [], [], []
        while not self.maybe("}"):
            plain = [self.tokens[min(self.i + k, len(self.tokens) - 1)][0] == "name" for k in range(3)]
            if plain[0] and (self.peek("in", ahead=1) or self.peek("not", ahead=1)):
                v, no = self.take(kind="name"), self.maybe("not")
                self.take("in")
                members.append((v, not no, self.take(kind="name")))
            elif all(plain):
                edges.append((self.take(kind="name"), self.take(kind="name"), self.take(kind="name")))
            else:
                conditions.append(self.expression())
            while self.maybe(";"):
                pass
        return Statement("subgraph", s, {**ends, "edges": edges, "members": members, "conditions": conditions})

    def expression(self, level: int = 0):
        """Trees of tuples: ('num', x), ('str', x), ('name', x), ('call', name, args), ('.', tree, name, args) and (op, a, b)."""
        ranks = [("OR",), ("AND",), ("<", ">", "<=", ">=", "==", "!="), ("+", "-"), ("*", "/")]
        if level == len(ranks):
            return self.unary()
        a = self.expression(level + 1)
        while self.peek(*ranks[level]):
            op = self.take().upper()
            a = (op, a, self.expression(level + 1))
        return a

    def unary(self):
        if self.maybe("-"):
            return ("-", ("num", 0.0), self.unary())
        if self.maybe("("):
            e = self.expression()
            self.take(")")
        elif self.tokens[self.i][0] == "number":
            return ("num", float(self.take()))
        elif self.tokens[self.i][0] == "string":
            return ("str", self.take()[1:-1])
        else:
            e = ("name", self.take(kind="name"))
            if self.maybe("("):
                e = ("call", e[1], self.arguments())
        while self.maybe("."):
            member = self.take(kind="name")
            e = (".", e, member, self.arguments() if self.maybe("(") else None)
        return e

    def arguments(self) -> list:
        args = []
        while not self.maybe(")"):
            args.append(self.expression())
            if not self.peek(")"):
                self.take(",")
        return args


def parse(text: str) -> list[Statement]:
    return Parser(text).program()


@dataclass
class _Base:
    """Rows with all features that were made on them; views of one base share it."""

    df: DataFrame
    schema: schemas.EdgeSchema | None = None
    topk: set = field(default_factory=set)


@dataclass
class Stream:
    base: _Base
    keys: list[str] = field(default_factory=list)
    collapsed: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.base.df


OPS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "AND": lambda a, b: a & b, "OR": lambda a, b: a | b,
}
CONNECTIONS = ("VertexInfo",)


class Planner:
    """Runs statements over given edge tables (edge_id, ts and the schema's columns); nothing is computed until an action.

    mode 'eh' gives sum, ave and var the exponential histogram's window, 'exact' the last N rows. With `ranges`, top-k numbers a
    key's rows in so many ranges of the order, for keys that hold a large share of all rows.
    """

    def __init__(self, inputs: dict[str, DataFrame], mode: str = "eh", max_offset: float = 100.0, ranges: int = 0):
        self.inputs, self.mode, self.max_offset, self.ranges = inputs, mode, max_offset, ranges
        self.settings = {"WINDOWSIZE": 10_000, "EHK": 2, "BASICWINDOWSIZE": 1000, "TOPK": 2}
        self.streams: dict[str, Stream] = {}
        self.features: dict[str, str] = {}
        self.info: dict[str, DataFrame] = {}
        self.matches: list[DataFrame] = []

    def run(self, program: str | list[Statement]) -> Planner:
        for s in parse(program) if isinstance(program, str) else program:
            getattr(self, "_" + s.kind)(s)
        return self

    def _stream_of(self, name: str) -> Stream:
        if name not in self.streams:
            raise SyntaxFault(f"no stream is named {name}")
        return self.streams[name]

    def _set(self, s: Statement) -> None:
        alias = {"EXPONENTIALHISTOGRAMK": "EHK", "HWM": "HIGHWATERMARK"}
        self.settings[alias.get(s.name.upper(), s.name.upper())] = s.args["value"]

    def _connect(self, s: Statement) -> None:
        if s.name not in self.inputs:
            raise SyntaxFault(f"no input is given for {s.name}")
        if s.args["type"] in CONNECTIONS:
            self.info[s.name] = self.inputs[s.name]
        else:
            self.streams[s.name] = Stream(_Base(self.inputs[s.name], schemas.schema(s.args["type"])))

    def _partition(self, s: Statement) -> None:
        self._stream_of(s.name)  # each grouping has its own exchange; no copies are needed

    def _hash(self, s: Statement) -> None:
        from rillgraph.functions.scalars import HASHES

        if s.args["fn"] not in HASHES:
            raise SyntaxFault(f"no hash function is named {s.args['fn']}")

    def _stream(self, s: Statement) -> None:
        of = self._stream_of(s.args["of"])
        self.streams[s.name] = Stream(of.base, [self._field(of, k) for k in s.args["keys"]])

    def _field(self, of: Stream, name: str) -> str:
        if of.base.schema:
            name = of.base.schema.aliases.get(name, of.base.schema.aliases.get(name.capitalize(), name))
        found = [c for c in of.df.columns if c == name] or [c for c in of.df.columns if c.lower() == name.lower()]
        if not found:
            raise SyntaxFault(f"no field or feature is named {name}")
        return found[0]

    def column(self, of: Stream, e) -> Column:
        if e[0] in ("num", "str"):
            return F.lit(e[1])
        if e[0] == "name":
            return F.col(self._field(of, e[1]))
        if e[0] == ".":
            name, member = self._field(of, e[1][1]), e[2].lower()
            i = int(e[3][0][1]) if e[3] else 0
            if member == "value":
                return topk.value_at(name, i)
            if member == "key":
                return F.get(F.col(name), F.lit(i))["key"]
            if member == "prev":
                return transform.previous(name, of.keys, i or 1)
            raise SyntaxFault(f"no member is named {e[2]}")
        if e[0] in OPS:
            return OPS[e[0]](self.column(of, e[1]), self.column(of, e[2]))
        raise SyntaxFault(f"can't evaluate {e[0]}")

    def _generate(self, s: Statement) -> None:
        of, op, name = self._stream_of(s.args["of"]), s.args["op"], s.name
        numbers = [int(a[1]) for a in s.args["args"][1:]]
        n = numbers[0] if numbers else self.settings["WINDOWSIZE"]
        k = numbers[1] if len(numbers) > 1 else self.settings["EHK"]
        base, first = of.base, s.args["args"][0]
        if first[0] == "name" and first[1] in of.collapsed:
            if op not in ("ave", "var"):
                raise SyntaxFault(f"a collapsed feature has ave and var, not {op}")
            drop = "_dropped"
            d = base.df.withColumn(drop, F.struct(*of.dropped))
            base.df = transform.collapse(d, self._field(of, first[1]), of.keys, drop, **{"mean" if op == "ave" else op: name}).drop(drop)
            return
        value = self.column(of, first)
        d = base.df.withColumn("_value", value)
        op = {"ehsum": "sum", "ehave": "ave", "ehvar": "var"}.get(op, op)
        if op == "topk":
            if len(numbers) != 3:
                raise SyntaxFault("topk takes a field, window, block and k")
            d = topk.topk(d, name, "_value", *numbers, of.keys, ranges=self.ranges)
            base.topk.add(name)
        elif op == "similarity":
            d = sequential.similarity(d, name, "_value", n, of.keys)
        elif op in ("sum", "ave", "var") and self.mode == "eh":
            d = histogram.features(d, "_value", n, k, of.keys, {op: name})
        elif op in windows.EXACT:
            d = windows.exact(d, name, op, "_value", n, of.keys)
        else:
            raise SyntaxFault(f"no operator is named {op}")
        base.df = d.drop("_value")

    def _filter(self, s: Statement) -> None:
        of = self._stream_of(s.args["of"])
        self.streams[s.name] = Stream(_Base(transform.keep(of.df, self.column(of, s.args["by"])), of.base.schema, set(of.base.topk)), of.keys)

    def _transform(self, s: Statement) -> None:
        of = self._stream_of(s.args["of"])
        d = transform.transform(of.df, s.args["as"], self.column(of, s.args["expression"]), of.keys)
        self.streams[s.name] = Stream(_Base(d), of.keys)

    def _collapse(self, s: Statement) -> None:
        of = self._stream_of(s.args["of"])
        keys = [self._field(of, k) for k in s.args["keys"]]
        self.streams[s.name] = Stream(of.base, keys, s.args["features"], [k for k in of.keys if k not in keys])

    def _subgraph(self, s: Statement) -> None:
        of, a = self._stream_of(s.name), s.args
        sch = of.base.schema
        edges = of.df.withColumns({"src": F.col(self._field(of, a["source"])), "dst": F.col(self._field(of, a["target"])), "t": F.expr(sch.time).cast("double"), "dur": F.coalesce(F.expr(sch.duration).cast("double"), F.lit(0.0))})
        names = [e[1] for e in a["edges"]]
        before, far, single, residual = [], {}, {}, []
        for c in a["conditions"]:
            op, x, y = c if len(c) == 3 else (None, None, None)
            if op in ("<", "<=") and x[0] == "call" and y[0] == "call":
                before.append((x[2][0][1], y[2][0][1]))
            elif op in ("<", "<=") and x[0] == "-" and x[1][0] == "call" and y[0] == "num":
                far[x[1][2][0][1], x[2][2][0][1]] = y[1]
            elif op in ("==", "!=", "<", ">", "<=", ">=") and x[0] == "." and x[1][0] == "name" and x[1][1] in names and y[0] in ("num", "str"):
                cond = OPS[op](F.col(self._field(of, x[2])), F.lit(y[1]))
                e = x[1][1]
                single[e] = single[e] & cond if e in single else cond
            else:
                residual.append(c)
        order = list(names)
        for _ in names:  # listed order, moved to fit start(a) < start(b)
            for p, q in before:
                if order.index(p) > order.index(q):
                    order.remove(p)
                    order.insert(order.index(q), p)
        p = Pattern(max_offset=self.max_offset)
        for name in order:
            src, _, trg = next(e for e in a["edges"] if e[1] == name)
            p.edge(src, name, trg, where=single.get(name))
        for name in order:
            hi = far.get((name, order[0]), self.max_offset)
            p.time("start", name, ">=", 0.0).time("start", name, "<=", 0.0 if name == order[0] else hi).time("end", name, ">=", 0.0).time("end", name, "<=", 1e12)
        for v, inside, what in a["members"]:
            if what in of.base.topk:
                edges = edges.withColumn(f"_{what}", topk.keys_of(what))
                p.vertex(v, inside, f"_{what}")
            else:
                st = self._stream_of(what)
                p.vertex(v, inside, st.df.select(F.col(st.keys[0])))
        found = match(edges, p)
        for (later, first), most in far.items():
            if first != order[0]:
                found = found.where(F.col(f"{later}.t") - F.col(f"{first}.t") <= most)
        for c in residual:
            found = self._compare_info(found, c)
        self.matches.append(found)

    def _compare_info(self, found: DataFrame, c) -> DataFrame:
        """Info(v).field op Info(w).field, or op a constant."""
        from rillgraph.sources.readers import vertex_info

        sides = []
        for k, x in enumerate(c[1:]):
            if x[0] in ("num", "str"):
                sides.append(F.lit(x[1]))
            elif x[0] == "." and x[1][0] == "call" and x[1][1] in self.info:
                table, prefix = self.info[x[1][1]], f"_i{k}_"
                found = vertex_info(found, table, x[1][2][0][1], table.columns[0], prefix)
                sides.append(F.col(prefix + x[2]))
            else:
                raise SyntaxFault(f"can't compare {x}")
        found = found.where(OPS[c[0]](*sides))
        return found.drop(*[n for n in found.columns if n.startswith("_i")])
