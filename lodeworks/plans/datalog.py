"""Rule programs: Datalog text to a stratified plan of DataFrames.

Supported: ``.decl`` (also after use), ``.input``/``.output``, facts, rules with several heads, negation, constants,
wildcards, comparisons, ``match`` and ``contains`` (full-string regular expression and substring), ``cat`` and
``to_string``, arithmetic, ``count : { … }``, ``min``/``max`` of a variable, subsumption (``R(…, a) <= R(…, b) :- …``
for min or max of the last column), ``#define`` and comments.

A program is split into strongly connected components; negation or aggregation inside one is an error.  Components
without recursion become one plan each, so Catalyst optimises across all their rules.  Recursive ones run semi-naive: a
round joins only the rows new in the round before; rounds are written to the checkpoint folder.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import policy
from lodeworks.operators.graph import NoFixpoint, transitive_closure
from lodeworks.session import cut

TYPES = {"symbol": "string", "number": "bigint", "unsigned": "bigint", "float": "double"}


class RuleError(ValueError):
    """The text is no valid program."""


@dataclass(frozen=True)
class Term:
    """``kind``: var, str, num, any, call, agg."""

    kind: str
    value: object = None
    args: tuple = ()


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple[Term, ...]
    negated: bool = False


@dataclass(frozen=True)
class Compare:
    op: str
    left: Term
    right: Term


@dataclass(frozen=True)
class Predicate:
    """``match`` or ``contains``."""

    name: str
    args: tuple[Term, Term]
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple = ()


@dataclass
class Program:
    decls: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    rules: list[Rule] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    inputs: list[str] = field(default_factory=list)
    #: Relation to ``min`` or ``max`` of its last column.
    subsumption: dict[str, str] = field(default_factory=dict)


_TOKEN = re.compile(r'\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<num>-?\d+(?:\.\d+)?)|(?P<id>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>:-|<=|>=|!=|[()<>=!,.:;{}+\-*/%]))')


class _Reader:
    def __init__(self, text: str):
        text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S)
        text = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*', lambda m: m.group(1) or " ", text)
        defines = dict(re.findall(r"(?m)^\s*#define\s+(\w+)\s+(.+?)\s*$", text))
        text = re.sub(r"(?m)^\s*#.*$", " ", text)
        for k, v in defines.items():
            text = re.sub(rf'("(?:[^"\\]|\\.)*")|\b{re.escape(k)}\b', lambda m, v=v: m.group(1) or v, text)
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise RuleError(f"cannot read: {text[at : at + 40].strip()!r}")
            kind = m.lastgroup
            value = m.group(kind)
            if kind == "id" and value.endswith("."):  # the end of a clause, not part of a name
                value = value.rstrip(".")
                at = m.start(kind) + len(value)
            else:
                at = m.end()
            self.tokens.append((kind, value))
        self.i = 0

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.i + ahead][1] if self.i + ahead < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        if self.i >= len(self.tokens):
            raise RuleError("the program ends too early")
        v = self.tokens[self.i][1]
        if want is not None and v != want:
            raise RuleError(f"{want!r} expected, found {v!r}")
        self.i += 1
        return v

    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else "end"


def parse(text: str) -> Program:
    """Rule text to a program."""
    r, p = _Reader(text), Program()
    while r.peek() is not None:
        if r.peek() == ".":
            r.take()
            word = r.take()
            if word == "decl":
                name = r.take()
                r.take("(")
                cols = []
                while r.peek() != ")":
                    col = r.take()
                    r.take(":")
                    cols.append((col, r.take()))
                    if r.peek() == ",":
                        r.take()
                r.take(")")
                if name in p.decls:
                    raise RuleError(f"{name} is declared twice")
                p.decls[name] = cols
            elif word in ("output", "input"):
                name = r.take()
                (p.outputs if word == "output" else p.inputs).append(name)
                if r.peek() == "(":
                    while r.take() != ")":
                        pass
            else:
                raise RuleError(f"unknown directive .{word}")
            continue
        heads = [_atom(r)]
        if r.peek() == "<=":
            r.take()
            other = _atom(r)
            r.take(":-")
            body = _body(r)
            r.take(".")
            p.subsumption[heads[0].name] = _direction(heads[0], other, body)
            continue
        while r.peek() == ",":
            r.take()
            heads.append(_atom(r))
        bodies = [()]
        if r.peek() == ":-":
            r.take()
            bodies = [_body(r)]
            while r.peek() == ";":
                r.take()
                bodies.append(_body(r))
        r.take(".")
        p.rules += [Rule(h, b) for h in heads for b in bodies]
    return p


def _direction(kept_less: Atom, kept: Atom, body: tuple) -> str:
    """Which of two rows stays: that with the greater or the lesser last column."""
    if kept_less.name != kept.name or kept_less.args[:-1] != kept.args[:-1]:
        raise RuleError("subsumption must compare rows of one relation that agree in all but the last column")
    a, b = kept_less.args[-1], kept.args[-1]
    for c in body:
        if isinstance(c, Compare) and c.op in ("<", "<=", ">", ">="):
            less = c.op[0] == "<"
            if (c.left, c.right) == (a, b):
                return "max" if less else "min"
            if (c.left, c.right) == (b, a):
                return "min" if less else "max"
    raise RuleError("subsumption needs a comparison of the last columns")


def _atom(r: _Reader, negated: bool = False) -> Atom:
    name = r.take()
    r.take("(")
    args = []
    while r.peek() != ")":
        args.append(_term(r))
        if r.peek() == ",":
            r.take()
    r.take(")")
    return Atom(name, tuple(args), negated)


def _term(r: _Reader) -> Term:
    left = _factor(r)
    while r.peek() in ("+", "-", "*", "/", "%"):
        left = Term("call", r.take(), (left, _factor(r)))
    return left


def _factor(r: _Reader) -> Term:
    kind, v = r.kind(), r.take()
    if kind == "str":
        return Term("str", v[1:-1].replace('\\"', '"').replace("\\\\", "\\"))
    if kind == "num":
        return Term("num", float(v) if "." in v else int(v))
    if v == "(":
        t = _term(r)
        r.take(")")
        return t
    if v == "_":
        return Term("any")
    if v in ("count", "min", "max", "sum") and r.peek() in (":",) or (v in ("min", "max", "sum") and r.kind() == "id" and r.peek(1) == ":"):
        over = Term("var", r.take()) if r.peek() != ":" else None
        r.take(":")
        r.take("{")
        body = _body(r)
        r.take("}")
        return Term("agg", v, (over, body))
    if r.peek() == "(":
        r.take()
        args = []
        while r.peek() != ")":
            args.append(_term(r))
            if r.peek() == ",":
                r.take()
        r.take(")")
        return Term("call", v, tuple(args))
    if kind != "id":
        raise RuleError(f"a term was expected, found {v!r}")
    return Term("var", v)


def _body(r: _Reader) -> tuple:
    out = [_literal(r)]
    while r.peek() == ",":
        r.take()
        out.append(_literal(r))
    return tuple(out)


def _literal(r: _Reader):
    negated = r.peek() == "!"
    if negated:
        r.take()
    if r.peek() in ("match", "contains") and r.peek(1) == "(":
        a = _atom(r)
        if len(a.args) != 2:
            raise RuleError(f"{a.name} takes two arguments")
        return Predicate(a.name, a.args, negated)
    if r.kind() == "id" and r.peek(1) == "(" and r.peek() not in ("cat", "to_string"):
        return _atom(r, negated)
    left = _term(r)
    op = r.take()
    if op not in ("=", "!=", "<", "<=", ">", ">="):
        raise RuleError(f"a comparison was expected, found {op!r}")
    return Compare(op, left, _term(r))


# ---------------------------------------------------------------------------------------------------------------------
# Stratification


def _refs(body: tuple) -> list[tuple[str, bool]]:
    """(relation, must be complete) of a body."""
    out = []
    for x in body:
        if isinstance(x, Atom):
            out.append((x.name, x.negated))
        elif isinstance(x, Compare):
            for t in (x.left, x.right):
                out += _agg_refs(t)
    return out


def _agg_refs(t: Term) -> list[tuple[str, bool]]:
    if t.kind == "agg":
        return [(n, True) for n, _ in _refs(t.args[1])]
    return [r for a in t.args if isinstance(a, Term) for r in _agg_refs(a)]


def strata(p: Program) -> list[list[str]]:
    """Strongly connected components of the relations with rules, dependencies first."""
    heads = {r.head.name for r in p.rules}
    deps: dict[str, dict[str, bool]] = {h: {} for h in heads}
    for r in p.rules:
        for n, strict in _refs(r.body):
            if n in heads:
                deps[r.head.name][n] = deps[r.head.name].get(n, False) or strict
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(deps[v]):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            comp = []
            while True:
                w = stack.pop()
                comp.append(w)
                if w == v:
                    break
            out.append(sorted(comp))

    for h in sorted(heads):
        if h not in index:
            visit(h)
    for comp in out:
        for a in comp:
            for b in comp:
                if deps[a].get(b):
                    raise RuleError(f"{a} depends on its own complement or aggregate through {b}")
    return out


# ---------------------------------------------------------------------------------------------------------------------
# Plans


class Engine:
    """Evaluates programs over input relations given as DataFrames (columns by position)."""

    def __init__(self, spark: SparkSession, relations: Mapping[str, DataFrame], max_rounds: int = 1000):
        self.spark, self.max_rounds = spark, max_rounds
        self.relations: dict[str, DataFrame] = {n: self._positional(d) for n, d in relations.items()}

    @staticmethod
    def _positional(d: DataFrame) -> DataFrame:
        out = []
        for i, (c, t) in enumerate(d.dtypes):
            col = F.col(f"`{c}`")
            out.append((col.cast("int").cast("bigint") if t == "boolean" else col.cast("bigint") if t in ("int", "smallint", "tinyint") else col if t in ("bigint", "double", "string") else col.cast("string")).alias(f"c{i}"))
        return d.select(*out)

    def run(self, text: str, declared: Mapping[str, list[tuple[str, str]]] | None = None, only: set[str] | None = None) -> dict[str, DataFrame]:
        """Output relations of a program, named columns as declared.

        ``declared`` are relations the text need not declare; ``only`` leaves all but these relations, and what they are made
        of, alone and the engine as it was.
        """
        p = parse(text)
        for n, cols in (declared or {}).items():
            if n in p.decls and [t for _, t in p.decls[n]] != [t for _, t in cols]:
                raise RuleError(f"{n} is declared with other columns than it has")
            p.decls.setdefault(n, cols)
        if only is not None:
            needed, more = set(), set(only)
            while more:
                needed |= more
                more = {n for r in p.rules if r.head.name in needed for n, _ in _refs(r.body)} - needed
            p.rules = [r for r in p.rules if r.head.name in needed]
            p.outputs = sorted(only)
            sub = Engine(self.spark, {}, self.max_rounds)
            sub.relations = dict(self.relations)
            return sub._run(p)
        return self._run(p)

    def _run(self, p: Program) -> dict[str, DataFrame]:
        types: dict[str, list[str]] = {n: [TYPES.get(t, "string") for _, t in cols] for n, cols in p.decls.items()}
        heads = {r.head.name for r in p.rules}
        for n, cols in types.items():
            if n in self.relations and len(cols) != len(self.relations[n].columns):
                raise RuleError(f"{n} is declared with {len(cols)} columns and has {len(self.relations[n].columns)}")
            if n not in self.relations and n not in heads:
                self.relations[n] = self._empty(cols)
        for r in p.rules:
            if r.head.name not in types:
                raise RuleError(f"{r.head.name} is not declared")
            if len(r.head.args) != len(types[r.head.name]):
                raise RuleError(f"{r.head.name} has {len(types[r.head.name])} columns, a rule gives {len(r.head.args)}")
        for comp in strata(p):
            self._component(p, comp, types)
        out = {}
        for n in p.outputs or sorted(heads):
            d = self.relations[n]
            out[n] = d.toDF(*[c for c, _ in p.decls[n]]) if n in p.decls else d
        return out

    def _empty(self, types: list[str]) -> DataFrame:
        return self.spark.createDataFrame([], ", ".join(f"c{i} {t}" for i, t in enumerate(types)))

    def _component(self, p: Program, comp: list[str], types: dict[str, list[str]]) -> None:
        inner = set(comp)
        rules = [r for r in p.rules if r.head.name in inner]
        recursive = [r for r in rules if any(n in inner for n, _ in _refs(r.body))]
        base = [r for r in rules if r not in recursive]
        given = {n: self.relations.get(n) for n in comp}
        for n in comp:
            parts = [self._rule(r, self.relations, types[n]) for r in base if r.head.name == n]
            if given[n] is not None:
                parts.append(given[n])
            d = reduce(DataFrame.union, parts).distinct() if parts else self._empty(types[n])
            self.relations[n] = self._subsumed(p, n, d)
        if not recursive:
            return
        for n in comp:
            self.relations[n] = cut(self.relations[n])
        delta = {n: self.relations[n] for n in comp}
        for _ in range(self.max_rounds):
            fresh: dict[str, list[DataFrame]] = {n: [] for n in comp}
            for r in recursive:
                places = [i for i, x in enumerate(r.body) if isinstance(x, Atom) and x.name in inner]
                for i in places:  # one atom reads the rows new in the last round, the others all rows
                    fresh[r.head.name].append(self._rule(r, self.relations, types[r.head.name], {i: delta[r.body[i].name]}))
            new, done = {}, True
            for n in comp:
                if not fresh[n]:
                    new[n] = self._empty(types[n])
                    continue
                rows = reduce(DataFrame.union, fresh[n]).distinct()
                old = self.relations[n]
                if n in p.subsumption:
                    merged = cut(self._subsumed(p, n, old.union(rows)))
                    new[n] = cut(merged.exceptAll(old))
                    grown = merged
                else:
                    new[n] = cut(rows.join(old, old.columns, "left_anti"))
                    grown = None
                if not new[n].isEmpty():
                    done = False
                    new[n].grown = grown
            if done:
                return
            for n in comp:
                g = getattr(new[n], "grown", None)
                if g is not None:
                    self.relations[n] = g
                elif n not in p.subsumption:
                    self.relations[n] = cut(self.relations[n].union(new[n]))
            delta = new
        raise NoFixpoint(f"{', '.join(comp)} did not settle in {self.max_rounds} rounds")

    @staticmethod
    def _subsumed(p: Program, n: str, d: DataFrame) -> DataFrame:
        how = p.subsumption.get(n)
        if not how:
            return d
        keys, last = d.columns[:-1], d.columns[-1]
        agg = F.max(last) if how == "max" else F.min(last)
        return d.groupBy(*keys).agg(agg.alias(last)).select(*d.columns)

    # One rule --------------------------------------------------------------------------------------------------------

    def _rule(self, r: Rule, relations: Mapping[str, DataFrame], types: list[str], swap: Mapping[int, DataFrame] | None = None) -> DataFrame:
        if not r.body:
            row = self.spark.range(1)
            return row.select(*[self._expr(t, {}).cast(ty).alias(f"c{i}") for i, (t, ty) in enumerate(zip(r.head.args, types, strict=True))])
        frame, bound = self._solve(r.body, relations, swap or {}, {v for a in r.head.args for v in _vars(a)})
        missing = {v for a in r.head.args for v in _vars(a)} - bound
        if missing:
            raise RuleError(f"{r.head.name}: {', '.join(sorted(missing))} not bound")
        cols = {v: F.col(f"v_{v}") for v in bound}
        return frame.select(*[self._expr(a, cols).cast(ty).alias(f"c{i}") for i, (a, ty) in enumerate(zip(r.head.args, types, strict=True))]).distinct()

    def _solve(self, body: tuple, relations: Mapping[str, DataFrame], swap: Mapping[int, DataFrame], wanted: set[str]) -> tuple[DataFrame, set[str]]:
        frame: DataFrame | None = None
        bound: set[str] = set()
        positive = [(i, x) for i, x in enumerate(body) if isinstance(x, Atom) and not x.negated]
        rest = [x for x in body if not (isinstance(x, Atom) and not x.negated)]
        while positive:
            # Join what shares a variable first, so that nothing is multiplied without need.
            k = next((j for j, (_, a) in enumerate(positive) if bound & {v for t in a.args for v in _vars(t)}), 0)
            i, a = positive.pop(k)
            if a.name not in relations and i not in swap:
                raise RuleError(f"unknown relation {a.name}")
            d, names, later = self._scan(a, swap.get(i, relations.get(a.name)))
            needed_after = wanted | {v for _, x in positive for t in x.args for v in _vars(t)} | {v for x in [*rest, *later] for v in _needs(x)}
            if frame is None:
                frame = d
            else:
                on = [f"v_{v}" for v in sorted(names & bound)]
                if on:
                    frame = frame.join(d, on) if (names - bound) & needed_after else frame.join(d.select(*on).distinct(), on, "left_semi")
                    bound |= names
                    rest = later + rest
                    continue
                # Nothing in common with what is joined so far: its own conditions first, and if no head or other literal
                # needs its variables, it only asks whether there is such a row.
                for x in [x for x in rest if not isinstance(x, Atom) and _literal_vars(x) and set(_literal_vars(x)) <= names]:
                    done = self._apply(x, d, names, relations)
                    if done is not None:
                        d, _ = done
                        rest.remove(x)
                needed_after = wanted | {v for _, x in positive for t in x.args for v in _vars(t)} | {v for x in [*rest, *later] for v in _needs(x)}
                if not names & needed_after:
                    frame = frame.withColumn("_one", F.lit(1)).join(d.select(F.lit(1).alias("_one")).limit(1), "_one", "left_semi").drop("_one")
                else:
                    frame = frame.crossJoin(d)
            bound |= names
            rest = later + rest
        if frame is None:
            frame = self.spark.range(1).select(F.lit(1).alias("_unit"))
        pending = list(rest)
        while pending:
            for x in pending:
                done = self._apply(x, frame, bound, relations)
                if done is not None:
                    frame, bound = done
                    pending.remove(x)
                    break
            else:
                raise RuleError("a variable of a comparison or negation is not bound")
        return frame, bound

    def _scan(self, a: Atom, d: DataFrame) -> tuple[DataFrame, set[str], list]:
        if len(a.args) != len(d.columns):
            raise RuleError(f"{a.name} has {len(d.columns)} columns, a rule uses {len(a.args)}")
        cond, out, later = F.lit(True), {}, []
        filtered = False
        for i, t in enumerate(a.args):
            c = F.col(f"c{i}")
            if t.kind == "any":
                continue
            if t.kind == "var":
                if t.value in out:
                    cond, filtered = cond & (c == F.col(f"c{out[t.value]}")), True
                else:
                    out[t.value] = i
            elif t.kind in ("str", "num"):
                cond, filtered = cond & (c == self._expr(t, {}).cast(d.schema[i].dataType)), True
            else:  # an expression: bind the column and compare once its variables are known
                v = f"_e{id(a)}_{i}"
                out[v] = i
                later.append(Compare("=", Term("var", v), t))
        if filtered:
            d = d.where(cond)
        return d.select(*[F.col(f"c{i}").alias(f"v_{v}") for v, i in out.items()]) if out else d.select(F.lit(1).alias("_some")).limit(1).select(), set(out), later

    def _apply(self, x, frame: DataFrame, bound: set[str], relations: Mapping[str, DataFrame]):
        cols = {v: F.col(f"v_{v}") for v in bound}
        if isinstance(x, Atom):
            mine = {v for t in x.args for v in _vars(t)}
            if not mine <= bound:
                return None
            if x.name not in relations:
                raise RuleError(f"unknown relation {x.name}")
            d, names, later = self._scan(Atom(x.name, x.args), relations[x.name])
            if later:
                raise RuleError("expressions inside a negation are not supported")
            if not names:
                probe = self._scan_any(x, relations[x.name])
                return frame.withColumn("_one", F.lit(1)).join(probe, "_one", "left_anti").drop("_one"), bound
            return frame.join(d, [f"v_{v}" for v in sorted(names)], "left_anti"), bound
        if isinstance(x, Predicate):
            if not set(_literal_vars(x)) <= bound:
                return None
            a, b = (self._expr(t, cols).cast("string") for t in x.args)
            if x.name == "match":
                c = b.rlike(r"\A(?:" + x.args[0].value + r")\z") if x.args[0].kind == "str" else F.rlike(b, F.concat(F.lit(r"\A(?:"), a, F.lit(r")\z")))
            else:
                c = b.contains(a)
            return frame.where(~c if x.negated else c), bound
        for side, other in ((x.left, x.right), (x.right, x.left)):
            if x.op == "=" and side.kind == "var" and side.value not in bound:
                if other.kind == "agg":
                    return self._aggregate(other, side, frame, bound, relations)
                if set(_vars(other)) <= bound:
                    return frame.withColumn(f"v_{side.value}", self._expr(other, cols)), bound | {side.value}
        for side, other in ((x.left, x.right), (x.right, x.left)):
            if side.kind == "agg" and set(_vars(other)) <= bound:
                tmp = Term("var", f"_agg{id(side)}")
                frame, bound = self._aggregate(side, tmp, frame, bound, relations)
                return self._apply(Compare(x.op, tmp if side is x.left else other, other if side is x.left else tmp), frame, bound, relations)
        if not set(_literal_vars(x)) <= bound:
            return None
        a, b = self._expr(x.left, cols), self._expr(x.right, cols)
        ops = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        return frame.where(ops[x.op]), bound

    def _scan_any(self, x: Atom, d: DataFrame) -> DataFrame:
        cond = F.lit(True)
        for i, t in enumerate(x.args):
            if t.kind in ("str", "num"):
                cond = cond & (F.col(f"c{i}") == self._expr(t, {}).cast(d.schema[i].dataType))
        return d.where(cond).select(F.lit(1).alias("_one")).limit(1)

    def _aggregate(self, agg: Term, target: Term, frame: DataFrame, bound: set[str], relations: Mapping[str, DataFrame]):
        over, body = agg.args
        inner_vars = {v for x in body for v in _literal_vars(x)}
        shared = sorted(inner_vars & bound)
        sub, sub_bound = self._solve(body, relations, {}, inner_vars)
        names = [f"v_{v}" for v in sorted(sub_bound)]
        sub = sub.select(*names).distinct()
        name = f"v_{target.value}"
        how = {"count": F.count(F.lit(1)), "min": F.min, "max": F.max, "sum": F.sum}[agg.value]
        col = how if agg.value == "count" else how(f"v_{over.value}")
        keys = [f"v_{v}" for v in shared]
        g = sub.groupBy(*keys).agg(col.alias(name)) if keys else sub.agg(col.alias(name))
        out = frame.join(g, keys, "left" if agg.value == "count" else "inner") if keys else frame.crossJoin(g)
        if agg.value == "count":
            out = out.withColumn(name, F.coalesce(name, F.lit(0)))
        return out, bound | {target.value}

    def _expr(self, t: Term, cols: Mapping[str, Column]) -> Column:
        if t.kind in ("str", "num"):
            return F.lit(t.value)
        if t.kind == "var":
            return cols[t.value]
        if t.kind == "call":
            a = [self._expr(x, cols) for x in t.args]
            if t.value == "cat":
                return F.concat(*[x.cast("string") for x in a])
            if t.value == "to_string":
                return a[0].cast("string")
            if t.value == "to_number":
                return a[0].try_cast("bigint")
            if t.value == "strlen":
                return F.length(a[0])
            if t.value == "substr":
                return F.substring(a[0], a[1] + 1, a[2])
            if t.value in ("+", "-", "*", "%"):
                return {"+": a[0] + a[1], "-": a[0] - a[1], "*": a[0] * a[1], "%": a[0] % a[1]}[t.value]
            if t.value == "/":
                return F.floor(a[0] / a[1])
            return F.call_function(t.value, *a)  # functors: functions registered with the session
        raise RuleError(f"a {t.kind} cannot stand here")


def _vars(t: Term) -> list[str]:
    if t.kind == "var":
        return [t.value]
    return [v for a in t.args if isinstance(a, Term) for v in _vars(a)] if t.kind == "call" else []


def _literal_vars(x) -> list[str]:
    if isinstance(x, (Atom, Predicate)):
        return [v for t in x.args for v in _vars(t)]
    return _vars(x.left) + _vars(x.right)


def _needs(x) -> list[str]:
    """Variables a literal reads, those inside its aggregates included."""
    out = _literal_vars(x)
    if isinstance(x, Compare):
        for t in (x.left, x.right):
            if t.kind == "agg":
                out = out + [v for y in t.args[1] for v in _needs(y)]
    return out


def relations_read(text: str) -> list[str]:
    """Relations that a policy text refers to without defining them."""
    p = parse(text)
    heads = {r.head.name for r in p.rules}
    return sorted({n for r in p.rules for n, _ in _refs(r.body)} - heads)


#: Names and columns of the published relations of policy texts (fixed values).
POLICY_RELATIONS: dict[str, list[tuple[str, str]]] = {
    "Policy": [("policy", "symbol"), ("component", "number"), ("message", "symbol")],
    "apply_policy_to": [("policy", "symbol"), ("component", "number")],
    "restrict_to_analysis": [("analysis", "number")],
    "apply_to_analysis": [("analysis", "number")],
    "check_passed": [("component", "number"), ("check", "symbol")],
    "check_failed": [("component", "number"), ("check", "symbol")],
    "is_check": [("check", "symbol")],
    "transitive_dependency": [("parent", "number"), ("child", "number")],
}


def run_policies(engine: Engine, text: str) -> dict[str, DataFrame]:
    """A policy text, its verdicts (and whatever else it outputs) by relation.

    The text defines ``Policy`` and ``apply_policy_to`` and may restrict the analyses; it reads the published relations, which
    are made from the facts by the operators, not by rules, and only where the text reads them.  So are the verdicts.
    """
    facts = {n: engine.relations[n] for n in ("analysis", "component", "check_result", "dependency") if n in engine.relations}
    results = facts["check_result"].toDF("id", "check_id", "passed", "component_id")
    analysis = facts["analysis"].select(F.col("c0").alias("id"))
    component = facts["component"].toDF("id", "purl", "analysis_id")
    p = parse(text)
    heads = {r.head.name for r in p.rules}
    wanted = {n for r in p.rules for n, _ in _refs(r.body)}
    none = engine.spark.createDataFrame([], "analysis_id bigint")
    rules_first = engine.run(text, POLICY_RELATIONS, {"restrict_to_analysis"}) if "restrict_to_analysis" in heads else {}
    restriction = rules_first["restrict_to_analysis"].toDF("analysis_id") if rules_first else none
    analyses = policy.applied_analyses(analysis, restriction)
    made = {
        "apply_to_analysis": lambda: analyses,
        "check_passed": lambda: policy.check_passed(results),
        "check_failed": lambda: policy.check_passed(results, 0),
        "is_check": lambda: results.select("check_id").distinct(),
        "transitive_dependency": lambda: transitive_closure(facts["dependency"].toDF("parent", "child")),
    }
    for n in sorted(wanted - heads):
        if n in made and n not in engine.relations:
            engine.relations[n] = engine._positional(made[n]())
    out = engine.run(text, POLICY_RELATIONS)
    got = lambda n: engine.relations[n].toDF(*[c for c, _ in POLICY_RELATIONS[n]]).withColumnRenamed("component", "component_id") if n in engine.relations else engine._empty(["string", "bigint"]).toDF("policy", "component_id")
    v = policy.evaluate(got("Policy"), got("apply_policy_to"), analyses, component)
    named = lambda d: d.select(F.col("component_id").alias("component"), "purl", "policy")
    return {n: d for n, d in out.items() if n in p.outputs} | {
        "passed_policies": v.passed, "failed_policies": v.failed, "component_satisfies_policy": named(v.satisfies), "component_violates_policy": named(v.violates),
    }
