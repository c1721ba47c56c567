"""Rules for records, held as a table and compiled to one expression (Q3, Q4)."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import named

RULES_SCHEMA = "name string, column string, kind string, setting string"


@dataclass(frozen=True)
class Rule:
    """``column`` has to be as ``kind`` and its ``setting``, a JSON text, say.

    Kinds: ``given`` (not null; no setting), ``one_of`` (a list), ``length`` (least and most
    code points), ``range`` (least and most of a number, either may be null), ``pattern`` (a
    regular expression that is found in it), ``goes_with`` (another column, and an object with
    the values that go with each of that one's). Null is what ``given`` alone objects to.
    """

    name: str
    column: str
    kind: str
    setting: str = "null"

    def broken(self) -> Column:
        """Whether a row breaks the rule; never null."""
        if self.kind not in _KINDS:
            raise ValueError(f"rule {self.name!r}: kind {self.kind!r} is not among {sorted(_KINDS)}")
        try:
            kept = _KINDS[self.kind](named(self.column), json.loads(self.setting))
        except (ValueError, TypeError, AttributeError) as failure:
            raise ValueError(f"rule {self.name!r}: setting {self.setting!r} doesn't fit {self.kind!r}") from failure
        return ~F.coalesce(kept, F.lit(self.kind != "given"))


def _length(value: Column, setting: Sequence[int]) -> Column:
    least, most = setting
    return F.length(value).between(int(least), int(most))


def _range(value: Column, setting: Sequence[float | None]) -> Column:
    least, most = setting
    number = value.try_cast("double")
    kept = number.isNotNull()
    if least is not None:
        kept = kept & (number >= float(least))
    if most is not None:
        kept = kept & (number <= float(most))
    return F.when(value.isNotNull(), F.coalesce(kept, F.lit(False)))


def _goes_with(value: Column, setting: tuple[str, dict[str, list[str]]]) -> Column:
    other, table = setting
    listed = F.lit(False)
    for of, values in table.items():
        listed = listed | ((named(other) == of) & value.isin([str(v) for v in values]))
    return F.when(value.isNotNull() & named(other).isNotNull(), listed)


_KINDS: dict[str, Any] = {
    "given": lambda value, _: value.isNotNull(),
    "one_of": lambda value, setting: value.isin([str(v) for v in list(setting)]),
    "length": _length,
    "range": _range,
    "pattern": lambda value, setting: value.rlike(str(setting)),
    "goes_with": _goes_with,
}


def read_rules(table: DataFrame, most: int = 1_000) -> list[Rule]:
    """The rules of a table, by name; refuses more than ``most``, since all go into one plan."""
    rows = table.select("name", "column", "kind", "setting").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return sorted((Rule(r.name, r.column, r.kind, r.setting or "null") for r in rows), key=lambda r: r.name)


def violations(columns: Sequence[str], rules: Iterable[Rule]) -> Column:
    """The names of the rules that a row breaks, in the rules' order; empty for none.

    One projection without joins or Python, whatever the number of rules. A rule for a
    column that isn't there is refused before anything runs.
    """
    rules = list(rules)
    for rule in rules:
        if rule.column not in columns:
            raise ValueError(f"rule {rule.name!r}: column {rule.column!r} is not among {list(columns)}")
    names = [F.when(rule.broken(), rule.name) for rule in rules]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def check(rows: DataFrame, rules: Iterable[Rule], output: str = "violations") -> DataFrame:
    """``rows`` with the rules that each breaks in ``output``; rows are marked, never dropped."""
    if output.lower() in (c.lower() for c in rows.columns):
        raise ValueError(f"column {output!r} is there already")
    return rows.withColumn(output, violations(rows.columns, rules))
