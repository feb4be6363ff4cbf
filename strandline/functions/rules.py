"""Keyword rules, filters and patterns as column expressions; rule tables are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import substring_count, words

#: A rule table: intent -> phrases, in the order that breaks ties.
INTENTS = {
    "troubleshoot": ["error", "fault", "not work", "problem", "fail"],
    "calibration": ["calibrat", "adjust", "zero"],
    "connection": ["network", "connect", "pair", "cable"],
    "maintenance": ["clean", "replace", "service"],
    "specification": ["weight", "speed", "size", "range"],
    "installation": ["install", "mount", "set up"],
    "firmware": ["firmware", "update", "version"],
    "compatibility": ["compatib", "fits", "works with"],
    "accessory": ["accessor", "spare", "holder"],
    "procedure": ["step", "how to", "instruction"],
    "comparison": ["compare", "differ", "better"],
    "safety": ["warning", "danger", "safe"],
    "ordering": ["order", "price", "deliver"],
    "greeting": ["hello", "bonjour", "hola", "guten"],
    "explanation": ["what is", "why", "que ", "was ist"],
}
#: Words that tell English text.
ENGLISH = ["the", "a", "an", "and", "or", "of", "to", "in", "is", "for", "with", "on", "that", "this"]


def keyword_intent(text: Column, rules: dict[str, list[str]] = INTENTS) -> Column:
    """Struct of intent, confidence and secondary: most phrases found, then their length, then the order of the rules."""
    low = F.lower(text)
    found = []
    for place, (name, phrases) in enumerate(rules.items()):
        hits = [low.contains(p).cast("int") for p in phrases]
        count = sum(hits, F.lit(0))
        length = sum((h * len(p) for h, p in zip(hits, phrases, strict=True)), F.lit(0))
        found.append(F.struct(count.alias("n"), length.alias("length"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*found))
    by_count = F.array(*[F.struct(f["n"].alias("n"), f["place"].alias("place"), f["name"].alias("name")) for f in found])
    second = F.array_max(F.filter(by_count, lambda x: (x["n"] > 0) & (x["name"] != best["name"])))
    any_hit = best["n"] > 0
    return F.struct(
        F.when(any_hit, best["name"]).otherwise("general").alias("intent"),
        F.when(any_hit, F.least(F.lit(0.95), 0.5 + 0.15 * best["n"])).otherwise(0.5).alias("confidence"),
        F.when(any_hit, second["name"]).alias("secondary"),
    )


def retrieval_weights(text: Column, classes: list[tuple[str, float]], default: float = 0.5) -> Column:
    """Struct of lexical and dense, which add to one: the lexical weight is that of the first class whose pattern the text has."""
    first = F.coalesce(*[F.when(text.rlike(pattern), F.lit(weight)) for pattern, weight in classes], F.lit(default))
    return F.struct(first.alias("lexical"), F.round(1 - first, 6).alias("dense"))


def is_english(text: Column) -> Column:
    """At most a quarter beyond ASCII and, from fifteen words on, four of a hundred among common English ones."""
    n = F.length(text)
    foreign = F.length(F.regexp_replace(text, r"[\x00-\x7F]", ""))
    found = words(text)
    common = F.size(F.filter(found, lambda w: w.isin(ENGLISH)))
    return F.when(n == 0, F.lit(False)).when(foreign / n > 0.25, F.lit(False)).when(F.size(found) < 15, F.lit(True)).otherwise(common / F.greatest(F.size(found), F.lit(1)) >= 0.04)


def lacks_capability(text: Column, phrases: list[str], times: int = 2) -> Column:
    """Whether some phrase stands in the text so often that the text is about what a product lacks."""
    low = F.lower(text)
    return F.array_max(F.array(*[substring_count(low, p) for p in phrases])) >= times


def mismatched_codes(text: Column, wanted: list[str]) -> Column:
    """Whether the text has codes of three capitals or more, none of them wanted; without codes it fits."""
    own = F.regexp_extract_all(text, F.lit("[A-Z]{3,}"), F.lit(0))
    return (F.size(own) > 0) & ~F.arrays_overlap(own, F.array(*map(F.lit, wanted)))


def product_context(family: Column, generic: Column, asked: str, aliases: list[str]) -> Column:
    return family.isin(asked, *aliases, "GENERAL", "UNKNOWN") | generic


def reject_reason(question: Column, answer: Column) -> Column:
    """Why a question and its answer are of no use as training text; null where they are."""
    return (
        F.when(answer.rlike(r"(?i)\b(see|apply) (the )?bulletin\b"), "bulletin")
        .when((F.length(answer) <= 100) & answer.rlike(r"(?i)\b(thanks|thank you|closed|feedback)\b"), "feedback only")
        .when((F.length(question) < 30) | (F.length(answer) < 30), "no content")
    )


def ticket_quality(question: Column, answer: Column, terms: list[str]) -> Column:
    """Steps for lengths and product words, at most one."""
    q, a = F.length(question), F.length(answer)
    both = F.lower(F.concat(question, answer))
    found = sum((both.contains(t).cast("int") for t in terms), F.lit(0))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    return F.least(F.lit(1.0), part(q >= 30, 0.15) + part(q >= 50, 0.10) + part(a >= 100, 0.20) + part(a >= 200, 0.15) + part(found > 0, 0.20) + F.least(found * 0.05, F.lit(0.20)))


def password_errors(word: Column) -> Column:
    """What a password lacks, in fixed order."""
    rules = [(F.length(word) < 12, "length"), (~word.rlike("[A-Z]"), "upper"), (~word.rlike("[a-z]"), "lower"), (~word.rlike("[0-9]"), "digit"), (~word.rlike("[^A-Za-z0-9]"), "special")]
    return F.array_compact(F.array(*[F.when(c, name) for c, name in rules]))


def password_strength(word: Column) -> Column:
    n = F.length(word)
    part = lambda c, x: F.when(c, x).otherwise(0)
    return part(n >= 12, 25) + part(n >= 16, 10) + part(n >= 20, 5) + part(word.rlike("[A-Z]"), 15) + part(word.rlike("[a-z]"), 15) + part(word.rlike("[0-9]"), 15) + part(word.rlike("[^A-Za-z0-9]"), 20)


def torque_range(text: Column) -> Column:
    """Struct of low and high: "a to b Nm", else "a Nm - b Nm", else one value for both."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    value = lambda p, g: F.regexp_extract(text, p, g).try_cast("double")
    to, dash, one = rf"{number} to {number} ?Nm", rf"{number} ?Nm ?- ?{number} ?Nm", rf"{number} ?Nm"
    return F.struct(F.coalesce(value(to, 1), value(dash, 1), value(one, 1)).alias("low"), F.coalesce(value(to, 2), value(dash, 2), value(one, 1)).alias("high"))


def version_parts(version: Column, n: int) -> Column:
    """The numbers of a version, filled up with zeros to n, so that versions compare as arrays."""
    numbers = F.transform(F.split(version, "[.]"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), n)), 1, n)


def numbers_with_units(text: Column, units: list[str]) -> Column:
    """Array of (value, unit), units in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[0-9]+(?:[.][0-9]+)? ?(?:" + "|".join(units) + ")"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, "^([0-9.]+)", 1).cast("double").alias("value"), F.regexp_extract(m, "([a-z]+)$", 1).alias("unit")))


def ungrounded(answer: Column, context: Column, units: list[str], within: float = 0.01) -> Column:
    """The numbers with units in the answer that the context does not hold."""
    known = numbers_with_units(context, units)
    return F.filter(numbers_with_units(answer, units), lambda x: ~F.exists(known, lambda k: (k["unit"] == x["unit"]) & (F.abs(k["value"] - x["value"]) <= within)))


def cid_decoded(text: Column, shift: int = 0) -> Column:
    """(cid:N) as the character of that number and the shift; those beyond ASCII go."""
    parts = F.split(text, r"\(cid:")
    number = lambda p: F.regexp_extract(p, r"^([0-9]{1,6})\)", 1)
    rest = lambda p: F.regexp_replace(p, r"^[0-9]{1,6}\)", "")
    decoded = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.when(number(p) == "", F.concat(F.lit("(cid:"), p)).otherwise(F.concat(F.when((number(p).cast("int") + shift).between(1, 127), F.char(number(p).cast("long") + shift)).otherwise(""), rest(p))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(decoded, ""))
