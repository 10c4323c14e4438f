"""Package versions as text that sorts like the versions, and version ranges as nodes of a binary tree over major numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels of the tree of major numbers; greater numbers share its last leaf, and keys tell them apart.
LEVELS = 20
LAST = (1 << LEVELS) - 1

_RELEASE = r"^[vV=\s]*(?:(\d+)!)?(\d+(?:\.\d+)*)"
# The places of release phases around the release itself, which is 5.
_PHASES = {"dev": "1", "a": "2", "alpha": "2", "b": "3", "beta": "3", "c": "4", "rc": "4", "pre": "4", "preview": "4", "post": "6", "rev": "6", "r": "6"}
_PHASE = r"^[vV=\s]*(?:\d+!)?\d+(?:\.\d+)*[-_.]?(dev|alpha|a|beta|b|preview|pre|rc|c|post|rev|r)[-_.]?(\d*)"
#: A semantic version's other pre-releases, such as 1.0.0-next.3, come before all phases.
_OTHER = r"^[vV=\s]*\d+(?:\.\d+)*-([0-9A-Za-z])"


def _number(digits: Column) -> Column:
    """Digits of any length as text that sorts by value."""
    bare = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(bare).cast("string"), 3, "0"), bare)


def version_key(version: Column) -> Column:
    """Text that sorts as versions do: epoch, release numbers (trailing zeros don't count), then the phase before or after the
    release and its number. Build labels don't count. NULL where the text begins with no version."""
    lower = F.lower(version)
    epoch, release = F.regexp_extract(lower, _RELEASE, 1), F.regexp_extract(lower, _RELEASE, 2)
    bare = F.regexp_replace(release, r"(\.0+)+$", "")
    numbers = F.array_join(F.transform(F.split(bare, r"\."), _number), ".")
    phase = F.regexp_extract(lower, _PHASE, 1)
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _PHASES.items() for x in kv]), phase), F.when(lower.rlike(_OTHER), "0").otherwise("5"))
    step = F.regexp_extract(lower, _PHASE, 2)
    # ' ' ends the release numbers: it sorts before '.', so that 1 comes before 1.0.1
    key = F.concat(_number(F.when(epoch == "", "0").otherwise(epoch)), F.lit("!"), numbers, F.lit(" "), place, _number(F.when(step == "", "0").otherwise(step)))
    return F.when(release != "", key)


def major(version: Column) -> Column:
    """The leaf of a version: its first release number, or LAST; versions with an epoch share LAST too."""
    lower = F.lower(version)
    number = F.regexp_extract(lower, r"^[vV=\s]*(\d+)", 1).try_cast("long")
    return F.when(F.regexp_extract(lower, _RELEASE, 1) != "", LAST).otherwise(F.least(F.coalesce(number, F.lit(LAST)), F.lit(LAST))).cast("int")


def point_nodes(leaf: Column) -> Column:
    """The node of every level that holds a leaf."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda level: F.struct(level.alias("level"), _shifted(leaf, level).alias("node")))


def range_nodes(low: Column, high: Column) -> Column:
    """The few nodes (two per level at most) that together hold the leaves low to high, each leaf once."""
    nodes = "array<struct<level:int,node:int>>"
    start = F.struct(low.cast("int").alias("a"), (high + 1).cast("int").alias("b"), F.array().cast(nodes).alias("held"))

    def step(state: Column, level: Column) -> Column:
        a, b, live = state["a"], state["b"], state["a"] < state["b"]
        left, right = live & (a % 2 == 1), live & (b % 2 == 1)
        none = F.array().cast(nodes)
        own = lambda node: F.array(F.struct(level.alias("level"), node.cast("int").alias("node"))).cast(nodes)
        after = F.when(left, a + 1).otherwise(a), F.when(right, b - 1).otherwise(b)
        held = F.concat(state["held"], F.when(left, own(a)).otherwise(none), F.when(right & ~(left & (a + 1 > b - 1)), own(b - 1)).otherwise(none))
        return F.struct(F.floor(after[0] / 2).cast("int").alias("a"), F.floor(after[1] / 2).cast("int").alias("b"), held.alias("held"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["held"])


def _shifted(value: Column, by: Column) -> Column:
    return F.call_function("shiftright", value, by)
