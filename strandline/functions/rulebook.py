"""Classification by rule tables that the caller passes: scores, first matches and labels as column expressions.

Patterns are regular expressions for lower-case text. A table is a plain dict, in the order that breaks ties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A table of types: required patterns, of which ``least`` must occur, optional ones, and patterns of the file's name.
Types = dict[str, dict]


def hits(text: Column, pattern: str) -> Column:
    """How often a pattern occurs."""
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def _best(scored: list[tuple[Column, str]]) -> Column:
    """Struct of score and name: the largest score, of equal ones the first."""
    return F.array_max(F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (s, n) in enumerate(scored)]))


def document_type(text: Column, name: Column, types: Types, default: str = "general") -> Column:
    """Struct of type and confidence: ten points and two for each hit per required pattern that occurs, three per optional one, half
    as much again for each pattern of the name; nothing where too few required ones occur. A hundred points are certainty."""
    low, title, scored = F.lower(text), F.lower(name), []
    for kind, rule in types.items():
        found = [hits(low, p) for p in rule["required"]]
        points = _sum([F.when(h > 0, 10 + 2 * h).otherwise(0) for h in found]) + _sum([F.when(low.rlike(p), 3).otherwise(0) for p in rule.get("optional", [])])
        factor = reduce(lambda a, p: a * F.when(title.rlike(p), 1.5).otherwise(1.0), rule.get("names", []), F.lit(1.0))
        enough = _sum([(h > 0).cast("int") for h in found]) >= rule.get("least", 1)
        scored.append((F.when(enough, points * factor).otherwise(0.0), kind))
    best = _best(scored)
    any_ = best["score"] > 0
    return F.struct(F.when(any_, best["name"]).otherwise(default).alias("type"), F.when(any_, F.least(F.lit(1.0), best["score"] / 100)).otherwise(0.3).alias("confidence"))


def enriched_type(text: Column, path: Column, types: Types, shortcuts: dict[str, str], default: str = "general") -> Column:
    """The type that the path names, else the one with most points: two per required pattern that occurs, one per optional one."""
    low = F.lower(text)
    scored = [(_sum([F.when(low.rlike(p), 2).otherwise(0) for p in r["required"]]) + _sum([F.when(low.rlike(p), 1).otherwise(0) for p in r.get("optional", [])]), k) for k, r in types.items()]
    best = _best(scored)
    return F.coalesce(first_match(path, shortcuts), F.when(best["score"] > 0, best["name"]), F.lit(default))


def first_match(text: Column, rules: dict[str, str]) -> Column:
    """The name of the first pattern that occurs; null where none does. rules: pattern -> name."""
    return F.coalesce(*[F.when(F.lower(text).rlike(p), F.lit(n)) for p, n in rules.items()], F.lit(None).cast("string"))


def first_category(words: Column, categories: dict[str, list[str]]) -> Column:
    """The first category one of whose keywords is among the words; null where none is."""
    return F.coalesce(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, listed))), F.lit(n)) for n, listed in categories.items()], F.lit(None).cast("string"))


def labelled_intents(text: Column, rules: dict[str, list[str]], code: str, code_intent: str, near: float = 0.3, default: str = "general") -> Column:
    """Struct of primary, secondaries (two at most) and confidence.

    A rule with hits scores a half and a fifth for each, one at most. Others within ``near`` of the best are secondary. A text with a
    code gains a tenth, and without any rule it has the code's intent.
    """
    low = F.lower(text)
    scored = [F.struct(F.least(F.lit(1.0), F.when(n > 0, 0.5 + 0.2 * n).otherwise(0.0)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, ps) in enumerate(rules.items()) for n in [_sum([hits(low, p) for p in ps])]]
    ranked = F.reverse(F.array_sort(F.filter(F.array(*scored), lambda x: x["score"] > 0)))
    best = F.get(ranked, F.lit(0))
    rest = F.filter(F.slice(ranked, 2, len(rules)), lambda x: x["score"] >= best["score"] - near - 1e-9)
    coded = F.upper(text).rlike(code)
    none = F.size(ranked) == 0
    return F.struct(
        F.when(~none, best["name"]).when(coded, code_intent).otherwise(default).alias("primary"),
        F.transform(F.slice(rest, 1, 2), lambda x: x["name"]).alias("secondaries"),
        F.round(F.least(F.lit(1.0), F.when(none, 0.3).otherwise(best["score"]) + F.when(coded, 0.1).otherwise(0.0)), 6).alias("confidence"),
    )


def vocabulary_terms(text: Column, classes: dict[str, list[str]]) -> Column:
    """Struct of an array per class: its terms that occur in the text, in the table's order."""
    low = F.lower(text)
    return F.struct(*[F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in listed])).alias(name) for name, listed in classes.items()])
