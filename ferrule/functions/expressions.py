"""Evaluator of size expressions in source code: numbers, names, + - * / % **, comparisons, unary - and !, parentheses, strlen, sizeof, index and
field access. Unknown operands keep the expression symbolic. Plain numbers never reach Python (see `evaluate`)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\s*(0[xX][0-9a-fA-F]+|\d+\.\d+|\d+|\"[^\"]*\"|'[^']*'|[A-Za-z_][\w.]*(?:\[[^\]]*\])?|\*\*|<=|>=|==|!=|&&|\|\||[-+*/%()<>!,])")
# Binding strengths, and the sizes of C types in bytes.
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8}
SIZES = {"char": 1, "uint8_t": 1, "short": 2, "int": 4, "uint32_t": 4, "long": 8, "uint64_t": 8, "size_t": 8, "double": 8}


class _Parser:
    def __init__(self, text: str, env: dict):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(text)
            self.tokens.append(m[1])
            at = m.end()
        self.at, self.env = 0, env

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def climb(self, least: int = 0):
        left = self.unary()
        while (op := self.peek()) in BINARY and BINARY[op] >= least:
            self.take()
            right = self.climb(BINARY[op] + (op != "**"))
            left = combine(op, left, right)
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            x = self.unary()
            return f"(-{x})" if isinstance(x, str) else -x
        if self.peek() == "!":
            self.take()
            x = self.unary()
            return f"(!{x})" if isinstance(x, str) else not x
        return self.atom()

    def atom(self):
        t = self.take()
        if t == "(":
            x = self.climb()
            if self.take() != ")":
                raise ValueError("parenthesis")
            return x
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", t):
            return int(t, 16)
        if re.fullmatch(r"\d+", t):
            return int(t)
        if re.fullmatch(r"\d+\.\d+", t):
            return float(t)
        if self.peek() == "(" and re.match(r"[A-Za-z_]", t):
            self.take()
            arg = self.take() if self.peek() != ")" else ""
            if self.take() != ")":
                raise ValueError("call")
            if t == "strlen" and arg[:1] in "\"'":
                return len(arg) - 2
            if t == "strlen" and isinstance(self.env.get(arg), str):
                return len(self.env[arg])
            if t == "sizeof" and arg in SIZES:
                return SIZES[arg]
            return f"{t}({arg})"
        if t[:1] in "\"'":
            return t
        if re.match(r"[A-Za-z_]", t):
            return self.env.get(t, t)
        raise ValueError(t)


def combine(op: str, a, b):
    if isinstance(a, str) or isinstance(b, str):
        return f"({a} {op} {b})"
    if op in ("/", "%") and b == 0:
        return None
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "**": lambda: a**b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "==": lambda: a == b, "!=": lambda: a != b, "&&": lambda: bool(a and b), "||": lambda: bool(a or b)}[op]()


def evaluate_text(text: str, env: dict | None = None):
    """A number or boolean, a symbolic text where an operand is unknown, or None for what isn't an expression."""
    try:
        p = _Parser(text, env or {})
        x = p.climb() if p.tokens else None
        return x if p.at == len(p.tokens) else None
    except (ValueError, IndexError, TypeError, OverflowError):
        return None


def variables(text: str) -> set[str]:
    """Names in an expression that aren't called."""
    return {m[1] for m in re.finditer(r"\b([A-Za-z_]\w*)\b(?!\s*\()", re.sub(r"\"[^\"]*\"|'[^']*'", "", text))}


@F.pandas_udf(T.LongType())
def _evaluate_rest(code: pd.Series, env: pd.Series) -> pd.Series:
    def one(text, pairs):
        x = evaluate_text(text, dict(pairs or {})) if text else None
        return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and x == int(x) and abs(x) < 2**62 else None

    return pd.Series([one(t, e) for t, e in zip(code, env)], dtype="object")


def evaluate(code: Column, env: Column | None = None) -> Column:
    """Whole-number value of an expression column (null if it has none). Plain numbers are cast in the JVM; only the others go to the evaluator."""
    env = F.lit(None).cast("map<string,long>") if env is None else env
    plain = code.rlike(r"^\s*\d{1,18}\s*$")
    return F.coalesce(F.when(plain, F.trim(code)).cast("long"), _evaluate_rest(F.when(~plain, code), env))
