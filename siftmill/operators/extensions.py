"""User rules: catalogue rows plus a function from files, lines or facts to hits, or pattern rules as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from siftmill.operators.catalog import rule_catalog
from siftmill.operators.line_rules import LineRule, pattern_rule_hits
from siftmill.schemas import HIT_COLUMNS
from siftmill.sources.files import explode_lines


@dataclass
class RuleSet:
    """A registry passed around by value; nothing global."""

    rows: list[tuple] = field(default_factory=list)
    plans: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    patterns: list[LineRule] = field(default_factory=list)

    def register(self, row: tuple, plan: Callable[[DataFrame], DataFrame], over: str = "lines") -> None:
        """``row`` is a catalogue row; ``plan`` maps the ``files``, ``lines`` or ``facts`` DataFrame to hits."""
        if over not in ("files", "lines", "facts"):
            raise ValueError("over must be files, lines or facts")
        self.rows.append(row)
        self.plans.append((over, plan))

    def register_pattern(self, row: tuple, rule: LineRule) -> None:
        self.rows.append(row)
        self.patterns.append(rule)

    def catalog(self, spark: SparkSession) -> DataFrame:
        return rule_catalog(spark, self.rows)

    def hits(self, files: DataFrame, facts: DataFrame | None = None) -> DataFrame:
        inputs = {"files": files, "lines": explode_lines(files), "facts": facts}
        found = [plan(inputs[over]).select(*HIT_COLUMNS) for over, plan in self.plans]
        if self.patterns:
            found.append(pattern_rule_hits(files, self.patterns).select(*HIT_COLUMNS))
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return out
