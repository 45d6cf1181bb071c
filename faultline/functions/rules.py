"""Rule tables as Column expressions: ordered first match, many labels, path taxonomies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's (?m) takes \r and others for line ends too; (?d) leaves \n alone, as the rules mean it.
FLAGS = "(?id)"
FLAGS_MULTILINE = "(?idm)"


def any_of(text: Column, patterns: list[str], flags: str = FLAGS) -> Column:
    """One pass over the text for all patterns of a class."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def first_match(text: Column, rules: list[tuple[str, list[str]]], default: str, flags: str = FLAGS) -> Column:
    """The first rule, in order, one of whose patterns is found."""
    out = None
    for name, patterns in rules:
        found = any_of(text, patterns, flags)
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def labels(conditions: list[tuple[str, Column]]) -> Column:
    """Names of all conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in conditions)))


def multi_label(text: Column, rules: list[tuple[str, list[str]]], flags: str = FLAGS) -> Column:
    return labels([(name, any_of(text, patterns, flags)) for name, patterns in rules])


@dataclass(frozen=True)
class Layer:
    domain: str
    name: str
    level: int
    prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


def taxonomy(path: Column, layers: list[Layer]) -> Column:
    """struct(domain, layer, level) of a path, null if none holds it.

    Domains in the order of the table. Within one, prefixes come before patterns, and higher levels before lower ones.
    """
    out = None
    for domain in dict.fromkeys(x.domain for x in layers):
        own = sorted((x for x in layers if x.domain == domain), key=lambda x: -x.level)
        tests = [(x, [path.startswith(p) for p in x.prefixes]) for x in own] + [(x, [path.rlike(p) for p in x.patterns]) for x in own]
        for layer, conditions in tests:
            if not conditions:
                continue
            found = conditions[0]
            for c in conditions[1:]:
                found = found | c
            value = F.struct(F.lit(layer.domain).alias("domain"), F.lit(layer.name).alias("layer"), F.lit(layer.level).alias("level"))
            out = F.when(found, value) if out is None else out.when(found, value)
    return out if out is not None else F.lit(None)


def layer_label(layer: Column, level: Column) -> Column:
    """name (core), (framework), (specific), or (L and the level)."""
    kind = F.when(level == 0, "core").when(level == 1, "framework").when(level == 2, "specific").otherwise(F.concat(F.lit("L"), level.cast("string")))
    return F.concat(layer, F.lit(" ("), kind, F.lit(")"))
