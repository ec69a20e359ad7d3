"""The ranges of columns that Catalyst pushes down to tables, read from an optimised plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Comparisons of an attribute with a literal, as (bound from below, bound from above); and what they are with both sides exchanged.
COMPARED = {"EqualTo": (True, True), "EqualNullSafe": (True, True), "GreaterThan": (True, False), "GreaterThanOrEqual": (True, False), "LessThan": (False, True), "LessThanOrEqual": (False, True)}
TURNED = {"GreaterThan": "LessThan", "GreaterThanOrEqual": "LessThanOrEqual", "LessThan": "GreaterThan", "LessThanOrEqual": "GreaterThanOrEqual"}
MARK = "_table_"


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(found) -> list:
    return [found.apply(i) for i in range(found.length())]


def _split(condition) -> list:
    return [c for side in (condition.left(), condition.right()) for c in _split(side)] if _kind(condition) == "And" else [condition]


def _value(literal):
    value = literal.value()
    kind = literal.dataType().typeName()
    if value is None or kind not in ("byte", "short", "integer", "long", "float", "double", "string", "timestamp_ntz"):
        return None
    return value.toString() if kind == "string" else value


def _range(condition) -> tuple[int, object, object] | None:
    """(attribute, low, high) of a comparison or a list of values."""
    kind = _kind(condition)
    if kind in ("In", "InSet"):
        attribute = condition.value() if kind == "In" else condition.child()
        if kind == "InSet" or _kind(attribute) != "AttributeReference" or any(_kind(x) != "Literal" for x in _items(condition.list())):
            return None
        values = [_value(x) for x in _items(condition.list())]
        return None if None in values or not values else (attribute.exprId().id(), min(values), max(values))
    if kind not in COMPARED:
        return None
    left, right = condition.left(), condition.right()
    if _kind(left) == "Literal":
        left, right, kind = right, left, TURNED.get(kind, kind)
    if _kind(left) != "AttributeReference" or _kind(right) != "Literal":
        return None
    value = _value(right)
    low, high = COMPARED[kind]
    return None if value is None else (left.exprId().id(), value if low else None, value if high else None)


def pushed_down(query: DataFrame) -> dict[str, dict[str, tuple]]:
    """By table: of columns, the closed range [low, high] (None: no bound) outside of which no row counts. Tables are known by a column
    named after them, which nothing selects; one that is read more than once has no ranges."""
    found: dict[str, list[dict]] = {}

    def walk(node, conditions: list) -> None:
        kind = _kind(node)
        if kind == "LogicalRDD":
            own = {a.exprId().id(): a.name() for a in _items(node.output())}
            table = next((n.removeprefix(MARK) for n in own.values() if n.startswith(MARK)), None)
            ranges: dict[str, tuple] = {}
            for at, low, high in filter(None, map(_range, conditions)):
                if at in own:
                    a, b = ranges.get(own[at], (None, None))
                    ranges[own[at]] = (low if a is None else a if low is None else max(a, low), high if b is None else b if high is None else min(b, high))
            found.setdefault(table, []).append(ranges)
            return
        if kind == "Filter":
            conditions = conditions + _split(node.condition())
        elif kind != "Project":
            conditions = []
        for child in _items(node.children()):
            walk(child, conditions)

    walk(query._jdf.queryExecution().optimizedPlan(), [])
    return {t: r[0] for t, r in found.items() if len(r) == 1}
