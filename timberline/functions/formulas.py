"""Scale formulas given as text: arithmetic in x only, checked and never executed as code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")
# The functions a formula may use.
_FUNCTIONS = {"sqrt": F.sqrt, "exp": F.exp, "log": F.log, "abs": F.abs, "pow": F.pow}


class _Parser:
    """expression := term {+|- term}; term := unary {*|/ unary}; unary := -unary | power; power := atom [^ unary]"""

    def __init__(self, text: str, x: Column):
        self.x, self.tokens, at = x, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"formula can't be read at {text[at:]!r}")
            self.tokens.append(m.group(m.lastindex))
            at = m.end()
        self.tokens.append("")

    def take(self, *wanted: str) -> str:
        if self.tokens[0] in wanted:
            return self.tokens.pop(0)
        return ""

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise ValueError(f"formula: {wanted!r} expected before {self.tokens[0]!r}")

    def expression(self) -> Column:
        v = self.term()
        while op := self.take("+", "-"):
            v = v + self.term() if op == "+" else v - self.term()
        return v

    def term(self) -> Column:
        v = self.unary()
        while op := self.take("*", "/"):
            w = self.unary()
            v = v * w if op == "*" else F.try_divide(v, w)
        return v

    def unary(self) -> Column:
        return -self.unary() if self.take("-") else self.power()

    def power(self) -> Column:
        v = self.atom()
        return F.pow(v, self.unary()) if self.take("^", "**") else v

    def atom(self) -> Column:
        t = self.tokens.pop(0)
        if t == "(":
            v = self.expression()
            self.need(")")
            return v
        if t == "x":
            return self.x
        if t in _FUNCTIONS:
            self.need("(")
            args = [self.expression()]
            while self.take(","):
                args.append(self.expression())
            self.need(")")
            return _FUNCTIONS[t](*args)
        try:
            return F.lit(float(t))
        except ValueError:
            raise ValueError(f"formula: {t!r} isn't allowed; it may use x, numbers, + - * / ^ and {', '.join(_FUNCTIONS)}") from None


def formula_column(text: str, x: Column) -> Column:
    p = _Parser(text, x)
    v = p.expression()
    if p.tokens != [""]:
        raise ValueError(f"formula: {p.tokens[0]!r} is left over")
    return v


def scale_column(formula: str | None, radius: str) -> Column:
    """The factor of a radius column: the formula in x, by default 1 / (2 x)^(1/8)."""
    return formula_column(formula or "1 / (2 * x) ^ (1 / 8)", F.col(radius))
