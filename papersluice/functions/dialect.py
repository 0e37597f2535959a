"""Expressions of strings and lists as SQL text for Spark, and for the engine that checks it.

The extractors are chains of regular expressions over one text; written
against this small vocabulary, they run on both.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'" if self.duck else 'r"' + s + '"' if '"' not in s else "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def first(self, t: str, p: str, g: int = 1) -> str:
        """Group g of the first match; null where there is none."""
        return f"nullif(regexp_extract({t}, {self.lit(p)}, {g}), '')"

    def all(self, t: str, p: str, g: int = 1) -> str:
        return f"regexp_extract_all({t}, {self.lit(p)}, {g})"

    def like(self, t: str, p: str) -> str:
        return f"regexp_matches({t}, {self.lit(p)})" if self.duck else f"({t} RLIKE {self.lit(p)})"

    def sub(self, t: str, p: str, r: str) -> str:
        return f"regexp_replace({t}, {self.lit(p)}, {self.lit(r)}, 'g')" if self.duck else f"regexp_replace({t}, {self.lit(p)}, {self.lit(r)})"

    def keep(self, a: str, cond, v: str = "x") -> str:
        return f"list_filter({a}, lambda {v}: {cond(v)})" if self.duck else f"filter({a}, {v} -> {cond(v)})"

    def map(self, a: str, f, v: str = "x") -> str:
        return f"list_transform({a}, lambda {v}: {f(v)})" if self.duck else f"transform({a}, {v} -> {f(v)})"

    def at(self, a: str, i: str) -> str:
        """Element from 0; null beyond the end."""
        return f"({a})[CAST({i} AS INT) + 1]" if self.duck else f"get({a}, CAST({i} AS INT))"

    def size(self, a: str) -> str:
        return f"len({a})" if self.duck else f"size({a})"

    def range(self, lo: str, hi: str) -> str:
        """lo to hi - 1."""
        return f"range({lo}, {hi})" if self.duck else f"(CASE WHEN {hi} > {lo} THEN sequence({lo}, {hi} - 1) ELSE array() END)"

    def slice(self, a: str, start: str, n: int) -> str:
        """n elements from start (from 0)."""
        return f"({a})[CAST({start} AS INT) + 1 : CAST({start} AS INT) + {n}]" if self.duck else f"slice({a}, CAST({start} AS INT) + 1, {n})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')" if self.duck else f"array_join({a}, '{sep}')"

    def split(self, t: str, sep: str) -> str:
        return f"string_split({t}, {sep})" if self.duck else f"split({t}, {sep})"

    def array(self, *xs: str) -> str:
        return "[" + ", ".join(xs) + "]" if self.duck else "array(" + ", ".join(xs) + ")"

    def concat_lists(self, *xs: str) -> str:
        out = xs[0]
        for x in xs[1:]:
            out = f"list_concat({out}, {x})" if self.duck else f"concat({out}, {x})"
        return out

    def distinct(self, a: str) -> str:
        return f"list_distinct({a})" if self.duck else f"array_distinct({a})"

    def head(self, a: str) -> str:
        return self.at(a, "0")

    def total(self, a: str) -> str:
        """Sum of doubles, in order; 0 for none."""
        return f"coalesce(list_sum({a}), 0)::DOUBLE" if self.duck else f"aggregate({a}, 0D, (acc, v) -> acc + v)"

    def sort(self, a: str) -> str:
        return f"list_sort({a})" if self.duck else f"array_sort({a})"

    def max(self, a: str) -> str:
        return f"list_max({a})" if self.duck else f"array_max({a})"

    def struct(self, **parts: str) -> str:
        if self.duck:
            return "{" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}"
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"

    def chars(self, t: str, p: str) -> str:
        """How many characters are of the class p, written without brackets."""
        return f"length(regexp_replace({t}, {self.lit(f'[^{p}]')}, '', 'g'))" if self.duck else f"length(regexp_replace({t}, {self.lit(f'[^{p}]')}, ''))"

    def number(self, x: str, digits: int) -> str:
        """With so many digits after the point."""
        shifted = f"floor({x} * {10**digits} + 0.5) / {self.double(10**digits)}"
        return f"CAST(CAST({shifted} AS DECIMAL(18, {digits})) AS {'VARCHAR' if self.duck else 'STRING'})"

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"


Stage = dict[str, str]


def staged(d: Dialect, source: str, stages: list[Stage]) -> str:
    """Nested selects, each adding the columns of a stage, so that later ones can name them."""
    for k, stage in enumerate(stages):
        source = f"(SELECT *, {', '.join(f'{v} AS {c}' for c, v in stage.items())} FROM {source} q{k})"
    return source


SPARK, DUCK = Dialect(False), Dialect(True)
