"""Scalar helpers: quoted names, missing values, keys and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

# Spellings of skill labels, and how tasks merge them.
ALIASES = {"beginner": "novice", "advancedbeginner": "advanced_beginner", "proficient_and_expert": "expert", "proficient_expert": "expert"}
THREE_CLASSES = {"novice": "novice", "advanced_beginner": "advanced_beginner", "competent": "advanced_beginner", "expert": "expert"}
TWO_CLASSES = {"novice": "novice", "expert": "expert"}
INSTRUMENTS = ("violin", "clarinet")


def c(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, the only missing value of the engine."""
    fixed = {f.name: F.when(~F.isnan(c(f.name)) & (F.abs(c(f.name)) < float("inf")), c(f.name)) for f in df.schema if isinstance(f.dataType, DoubleType | FloatType)}
    return df.select(*(fixed[n].alias(n) if n in fixed else c(n) for n in df.columns))


def number(x: Column) -> Column:
    """As a double; what is no number is missing."""
    v = x.try_cast("double")
    return F.when(~F.isnan(v), v)


def participant(x: Column) -> Column:
    return F.upper(F.trim(x.cast("string")))


def condition(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def block(x: Column) -> Column:
    return F.trim(x.cast("string")).try_cast("int")


def _mapped(x: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for kv in table.items() for v in kv)), x) if table else x


def canonical_label(x: Column) -> Column:
    """Lower case, blanks and hyphens as underscores, known aliases replaced."""
    v = F.translate(F.lower(F.trim(x.cast("string"))), " -", "__")
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(w) for kv in ALIASES.items() for w in kv)), v), v)


def task_label(x: Column, task: str) -> Column:
    """The class of a label in a 3-class or 2-class task; others are null."""
    table = {"3class": THREE_CLASSES, "2class": TWO_CLASSES}[task]
    return F.try_element_at(F.create_map(*(F.lit(w) for kv in table.items() for w in kv)), canonical_label(x))


def instrument(x: Column) -> Column:
    v = F.lower(F.trim(x.cast("string")))
    return F.when(v.isin(*INSTRUMENTS), v).otherwise("default")


def family(name: Column, prefixes: dict[str, tuple[str, ...]]) -> Column:
    """The family of a signal by the beginning of its name; null if none fits."""
    out = F.lit(None).cast("string")
    for k, starts in reversed(prefixes.items()):
        hit = F.lit(False)
        for s in starts:
            hit = hit | name.startswith(s)
        out = F.when(hit, k).otherwise(out)
    return out


def warning_status(warnings: Column) -> Column:
    """warning if a message tells of a mismatch or of remaining gaps."""
    return F.when(F.exists(warnings, lambda w: w.contains("mismatch") | w.contains("remaining")), "warning").otherwise("ok")


def counts_json(labels: Column, counts: Column) -> Column:
    """JSON of label counts, for an aggregate."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(labels, counts)))))


def find_column(columns: list[str], wanted: str) -> str:
    """The column of this name, whatever its case; names near ones on failure."""
    low = {x.lower(): x for x in reversed(columns)}
    if wanted.lower() in low:
        return low[wanted.lower()]
    near = [x for x in columns if re.sub(r"\W", "", wanted.lower())[:4] in re.sub(r"\W", "", x.lower())]
    raise ValueError(f"no column {wanted!r}; near: {near}")
