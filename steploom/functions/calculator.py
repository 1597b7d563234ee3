"""A total calculator for untrusted expressions: a reader by binding powers over bounded numbers, as a scalar Arrow function."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import functions as F, types as T


class Refused(ValueError):
    pass


def rounded(x, digits=None):
    if digits is not None and abs(digits) > 400:
        raise Refused("too many digits")
    return round(x, digits)


#: What the tool allows.
LONGEST, EXPONENT = 500, 64
FUNCTIONS = {"abs": abs, "round": rounded, "min": min, "max": max, "floor": math.floor, "ceil": math.ceil, "sqrt": math.sqrt}

#: Whole numbers of more bits could not be written out anyway.
BITS, DEPTH = 14_000, 100
TOKEN = re.compile(r"[ \t\f]*(?:(?P<number>(?:[0-9][0-9_]*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)(?![A-Za-z_0-9])|(?P<name>[A-Za-z_]+)|(?P<mark>\*\*|//|[-+*/%(),]))")
NUMBER = re.compile(r"0+(_0+)*|[1-9][0-9]*(_[0-9]+)*|[0-9]*\.[0-9]*([eE].+)?|[0-9]+[eE].+")
#: How strongly an operator binds what stands to its left and right; powers bind to the right, and above a sign before them.
INFIX = {"+": (10, 11), "-": (10, 11), "*": (20, 21), "/": (20, 21), "//": (20, 21), "%": (20, 21), "**": (40, 30)}
SIGN = 30


def bounded(x):
    if isinstance(x, int) and x.bit_length() > BITS:
        raise Refused("number too large")
    return x


def applied(op: str, a, b):
    if op == "**":
        if abs(b) > EXPONENT:
            raise Refused("exponent too large")
        if isinstance(a, int) and a.bit_length() * abs(b) > BITS + EXPONENT:
            raise Refused("number too large")
        return bounded(a**b)
    if op in ("/", "//", "%"):
        if not b:
            raise Refused("division by zero")
        return a / b if op == "/" else a // b if op == "//" else a % b
    return bounded(a * b if op == "*" else a + b if op == "+" else a - b)


class Reader:
    """Reads and computes in one pass; `next` is the token not yet used."""

    def __init__(self, text: str):
        self.tokens, self.depth = self.split(text), 0
        self.kind, self.next = next(self.tokens)

    @staticmethod
    def split(text: str):
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m or m.end() == at:
                raise Refused(f"not allowed: {text[at : at + 10].strip()}")
            yield m.lastgroup, m[m.lastgroup]
            at = m.end()
        yield "end", ""

    def take(self, what: str | None = None) -> str:
        token = self.next
        if what is not None and token != what:
            raise Refused(f"expected {what}")
        self.kind, self.next = next(self.tokens, ("end", ""))
        return token

    def number(self):
        s = self.take()
        if not NUMBER.fullmatch(s):
            raise Refused(f"not allowed: {s}")
        s = s.replace("_", "")
        return bounded(int(s)) if s.isdigit() else float(s)

    def operand(self):
        self.depth += 1
        if self.depth > DEPTH:
            raise Refused("nested too deeply")
        if self.kind == "number":
            x = self.number()
        elif self.next in ("+", "-"):
            x = self.value(SIGN) if self.take() == "+" else -self.value(SIGN)
        elif self.next == "(":
            self.take()
            x = self.value(0)
            self.take(")")
        elif self.kind == "name" and self.next in FUNCTIONS:
            name = self.take()
            self.take("(")
            given = []
            while self.next != ")":
                given.append(self.value(0))
                if self.next != ")":
                    self.take(",")
            self.take(")")
            x = bounded(FUNCTIONS[name](*given))
        else:
            raise Refused(f"not allowed: {self.next or 'end'}")
        self.depth -= 1
        return x

    def value(self, least: int):
        x = self.operand()
        while self.kind == "mark" and self.next in INFIX and INFIX[self.next][0] >= least:
            op = self.take()
            x = applied(op, x, self.value(INFIX[op][1]))
        return x

    def whole(self):
        x = self.value(0)
        if self.kind != "end":
            raise Refused(f"not allowed: {self.next}")
        return x


def shown(x) -> str:
    if isinstance(x, float) and not x.is_integer():
        return format(x, ".10g")
    return str(int(x))


def evaluate(text: str | None) -> tuple[str | None, str | None]:
    """(result, error): exactly one is NULL; never raises."""
    said = (text or "").strip()
    if not said or len(text) > LONGEST:
        return None, "expression too long" if said else "empty expression"
    try:
        x = Reader(said.translate({0xD7: "*", 0xF7: "/"}).rstrip("=")).whole()
        return (None, "not a real number") if isinstance(x, complex) else (shown(x), None)
    except (ArithmeticError, TypeError, ValueError) as e:
        return None, str(e) or type(e).__name__


@F.pandas_udf(T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())]))
def calculated(texts: pd.Series) -> pd.DataFrame:
    known = {t: evaluate(t) for t in texts.unique()}  # of one batch
    return pd.DataFrame([known[t] for t in texts], columns=["result", "error"])
