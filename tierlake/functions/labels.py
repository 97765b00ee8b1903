"""Label filters and path templates, turned into columns once on the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a variable in a path template.
TEMPLATE_VARIABLE = re.compile(r"\{([^}]+)\}")


def label(labels: Column, key: str) -> Column:
    return F.try_element_at(labels, F.lit(key))


def _value_list(text: str) -> list[str]:
    return [v.strip() for v in text.strip().removeprefix("[").removesuffix("]").split(",")]


def _condition(text: str, labels: Column) -> Column:
    never = F.lit(False)
    for operator in (" = ", " in "):
        name, found, value = text.partition(operator)
        name = name.strip()
        if found and name.startswith("label:"):
            values = [value.strip()] if operator == " = " else _value_list(value)
            # An absent label reads as the empty string, an absent map matches nothing.
            actual = F.coalesce(label(labels, name.removeprefix("label:")), F.lit(""))
            return labels.isNotNull() & actual.isin(values)
    for prefix in ("label:", "target:"):
        if text.startswith(prefix):
            return F.coalesce(F.map_contains_key(labels, F.lit(text.removeprefix(prefix))), never)
    return never


def label_filter(expression: str | None, labels: Column | str = "labels") -> Column:
    """Boolean column of a label filter.

    Forms: ``label:K``, ``label:K = V``, ``label:K in [a, b]``, joined with AND
    and OR.  AND splits first, so OR binds tighter.  An empty filter matches
    everything, an unknown form nothing.
    """
    labels = F.col(labels) if isinstance(labels, str) else labels
    text = (expression or "").strip()
    if not text:
        return F.lit(True)
    clauses = [
        reduce(lambda a, b: a | b, [_condition(part.strip(), labels) for part in clause.strip().split(" OR ")])
        for clause in text.split(" AND ")
    ]
    return reduce(lambda a, b: a & b, clauses)


def saved_query(expression: str, labels: Column | str = "labels") -> Column:
    """Saved target query: one label test, and any other text selects everything."""
    labels = F.col(labels) if isinstance(labels, str) else labels
    text = (expression or "").strip()
    for operator in (" = ", " in "):
        if operator in text and text.partition(operator)[0].strip().startswith("label:"):
            return _condition(text, labels)
    return F.lit(True)


def template_path(template: str, name: Column, labels: Column, target: Column | None = None) -> Column:
    """Path of an entity from a template; NULL when any part is missing or empty.

    ``{name}`` is the entity, ``{label:K}`` a label of a target; for pollers
    ``{target}`` is the parent and ``{target:K}`` a label of the parent.
    """
    missing = F.lit(None).cast("string")
    parts, last = [], 0
    for match in TEMPLATE_VARIABLE.finditer(template):
        if match.start() > last:
            parts.append(F.lit(template[last : match.start()]))
        variable = match.group(1)
        if variable == "name":
            value = name
        elif variable == "target":
            value = target if target is not None else missing
        elif variable.startswith("label:"):
            value = label(labels, variable.removeprefix("label:")) if target is None else missing
        elif variable.startswith("target:"):
            value = label(labels, variable.removeprefix("target:")) if target is not None else missing
        else:
            value = missing
        parts.append(F.nullif(value, F.lit("")))
        last = match.end()
    if last < len(template):
        parts.append(F.lit(template[last:]))
    return F.concat(*parts)
