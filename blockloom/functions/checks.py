"""CHECK definitions of one column as conditions: a tokenizer and a recursive-descent parser that yields columns.

    check     = ["CHECK"] both
    both      = one ["AND" one]              two bounds, a lower and an upper one
    one       = test | "(" both ")"
    test      = value ( "IS" ["NOT"] "NULL" | ["NOT"] "IN" "(" constant {"," constant} ")" | "BETWEEN" constant "AND" constant
                      | comparison constant )
    value     = column | length "(" column ")" | "(" value ")", each with casts
    constant  = number | string | "TRUE" | "FALSE" | "(" constant ")", each with casts
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\s*(?:(?P<text>'(?:[^']|'')*')|(?P<number>[+-]?\d+(?:\.\d+)?)|(?P<cast>::)|(?P<op><=|>=|<>|!=|[<>=(),\[\]])|\"(?P<quoted>[^\"]+)\"|(?P<word>\w+))")
_COMPARE = {">=": operator.ge, "<=": operator.le, "<>": operator.ne, "!=": operator.ne, "=": operator.eq, ">": operator.gt, "<": operator.lt}
_LENGTHS = {"length": F.length, "char_length": F.length, "octet_length": F.octet_length}


@dataclass(frozen=True)
class _Test:
    holds: Column
    bound: str = ""  # ">" or "<" if the test is a bound of that side
    counted: bool = False


class _Parser:
    def __init__(self, definition: str, column: str):
        self.definition, self.column, self.at = definition, column, 0
        self.tokens: list[tuple[str, str]] = []
        at, end = 0, len(definition.rstrip())
        while at < end:
            m = _TOKENS.match(definition, at)
            if not m:
                raise self.refused()
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def refused(self) -> ValueError:
        return ValueError(f"not a check of {self.column} that can be read: {self.definition!r}")

    def next_is(self, *texts: str) -> bool:
        """Whether the next tokens, as words or signs, are these; if so they are passed."""
        ahead = self.tokens[self.at : self.at + len(texts)]
        if [t.upper() if kind in ("word", "op", "cast") else None for kind, t in ahead] != list(texts):
            return False
        self.at += len(texts)
        return True

    def need(self, text: str) -> None:
        if not self.next_is(text):
            raise self.refused()

    def take(self, *kinds: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] not in kinds:
            raise self.refused()
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self, first, second):
        """What ``first`` reads here or, where that fails, what ``second`` does."""
        at = self.at
        try:
            return first()
        except ValueError:
            self.at = at
            return second()

    def check(self) -> Column:
        self.next_is("CHECK")
        test = self.both()
        if self.at < len(self.tokens):
            raise self.refused()
        return test.holds

    def both(self) -> _Test:
        left = self.one()
        if not self.next_is("AND"):
            return left
        right = self.one()
        if {left.bound, right.bound} != {"<", ">"}:
            raise self.refused()
        return _Test(left.holds & right.holds)

    def one(self) -> _Test:
        return self.either(self.test, lambda: self.inside(self.both))

    def inside(self, read):
        self.need("(")
        got = read()
        self.need(")")
        return got

    def test(self) -> _Test:
        value, counted = self.value()
        if self.next_is("IS", "NOT", "NULL"):
            return _Test(value.isNotNull())
        if self.next_is("IS", "NULL"):
            return _Test(value.isNull())
        refuse = self.next_is("NOT")
        if self.next_is("IN"):
            among = value.isin(self.inside(self.constants))
            return _Test(self.passed(~among if refuse else among))
        if refuse:
            raise self.refused()
        if self.next_is("BETWEEN"):
            low = self.constant()
            self.need("AND")
            return _Test(self.passed(value.between(F.lit(low), F.lit(self.constant()))))
        sign = self.take("op")[1]
        if sign not in _COMPARE:
            raise self.refused()
        limit = self.constant()
        if counted and not isinstance(limit, int):
            raise self.refused()
        return _Test(self.passed(_COMPARE[sign](value, F.lit(limit))), sign[0] if sign[0] in "<>" and sign != "<>" else "")

    @staticmethod
    def passed(test: Column) -> Column:
        return F.coalesce(test, F.lit(True))

    def value(self) -> tuple[Column, bool]:
        """The column or its length, and which of the two."""
        if self.next_is("("):
            got = self.value()
            self.need(")")
        else:
            kind, name = self.take("word", "quoted")
            if name == self.column:
                got = F.col(name), False
            elif kind == "word" and name.lower() in _LENGTHS:
                got = _LENGTHS[name.lower()](self.inside(self.value)[0]), True
            else:
                raise self.refused()
        self.casts()
        return got

    def constants(self) -> list:
        got = [self.constant()]
        while self.next_is(","):
            got.append(self.constant())
        return got

    def constant(self):
        if self.next_is("("):
            got = self.constant()
            self.need(")")
        else:
            kind, text = self.take("text", "number", "word")
            if kind == "text":
                got = text[1:-1].replace("''", "'")
            elif kind == "number":
                got = Decimal(text) if "." in text else int(text)
            elif text.lower() in ("true", "false"):
                got = text.lower() == "true"
            else:
                raise self.refused()
        self.casts()
        return got

    def casts(self) -> None:
        """Casts say the type that the column or constant has anyway."""
        while self.next_is("::"):
            self.take("word", "quoted")
            while self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1].lower() in ("varying", "precision", "without", "with", "time", "zone"):
                self.at += 1
            if self.next_is("("):
                self.take("number")
                while self.next_is(","):
                    self.take("number")
                self.need(")")
            while self.next_is("[", "]"):
                pass


def parse_check(definition: str, column: str) -> Column:
    """A CHECK definition on one column as a condition: comparison, BETWEEN, length(col) op n, [NOT] IN, IS [NOT] NULL, and AND of a
    lower and an upper bound. Anything else raises ValueError. As in SQL, null passes all but IS NOT NULL."""
    return _Parser(definition, column).check()
