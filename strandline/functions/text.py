"""Text functions as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic.
STOP_WORDS = ["the", "and", "for", "that", "this", "with", "from", "was", "are", "have", "has", "not", "but", "you", "your", "which"]


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def bm25_tokens(text: Column) -> Column:
    """Plain ASCII words of three characters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])[a-z0-9]{3,}(?![\p{L}\p{N}_])"), F.lit(0))


def eval_tokens(text: Column) -> Column:
    """Words of the evaluation: tags stripped, a letter first, at least two characters, inner hyphens kept."""
    plain = F.regexp_replace(F.lower(text), "<[^>]*>", " ")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}_\-]+"), lambda w: w.rlike(r"^[a-z][a-z0-9\-]+$"))


def keyword_set(text: Column, least: int = 4) -> Column:
    """Distinct evaluation tokens of some length that are no stop words, sorted."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_sort(F.array_distinct(F.filter(eval_tokens(text), lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))))


def normalised_query(text: Column) -> Column:
    """Lower case, everything but letters, digits, underscores and hyphens as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\-]+", " "))


def normalised_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cleaned_paragraphs(text: Column) -> Column:
    """Paragraphs (parted by blank lines) with their line breaks unwrapped; empty ones go."""
    parts = F.split(F.regexp_replace(text, "\r\n", "\n"), r"\n[ \t]*\n+")
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != ""), "\n\n")


def cleaned_chunk(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), " {2,}", " "))


#: Noise of correspondence: markup, separators, links, addresses, ticket numbers, mobile signatures.
NOISE = [r"(?is)<[^>]+>", r"[-_=*]{5,}", r"(?i)https?://\S+", r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", r"(?i)ticket\s*#?\s*\d+", r"(?is)sent from my .*$", r"(?is)best regards.*$"]


def without_noise(text: Column) -> Column:
    for pattern in NOISE:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def substring_count(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def sentence_truncated(text: Column, n: int) -> Column:
    """The first n characters, cut after the last full stop where that lies past the middle."""
    head = F.substring(text, 1, n)
    dot = F.length(head) - F.instr(F.reverse(head), ".") + 1
    return F.when(F.length(text) <= n, text).when((F.instr(head, ".") > 0) & (dot > n / 2), F.substring(head, F.lit(1), dot)).otherwise(head)


def error_code(text: Column) -> Column:
    """The first error code of a text in its standard spelling: E and the number without leading zeros."""
    number = F.regexp_extract(F.upper(text), r"E[ \-]?0*([0-9]{1,4})", 1)
    return F.when(number != "", F.concat(F.lit("E"), number))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Phrases of each language that tell it apart.
LANGUAGE_WORDS = {
    "de": ["der", "die", "und", "ist", "das", "nicht", "von", "mit", "zu", "ein"],
    "fr": ["les", "des", "est", "une", "dans", "pour", "le", "et", "du", "avec"],
    "es": ["los", "que", "una", "del", "las", "por", "el", "con", "para", "en"],
    "en": ["the", "and", "that", "with", "of", "is", "for", "was", "are", "this"],
}


def language(text: Column) -> Column:
    """The language with most of its phrases among the text's words; ties by name, none: unknown."""
    found = words(text)

    def count(listed: list[str]) -> Column:
        return F.size(F.filter(found, lambda w: w.isin(listed)))

    counts = [F.struct(count(listed).alias("n"), F.lit(name).alias("name")) for name, listed in sorted(LANGUAGE_WORDS.items())]
    best = F.reduce(F.array(*counts[1:]), counts[0], lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return F.when(best["n"] > 0, best["name"]).otherwise("unknown")


def measures(text: Column) -> Column:
    """Each number with a unit as a struct of value and unit."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]+(?:\.[0-9]+)?) ?(Nm|kg|mm|rpm|V|A)"), F.lit(0))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^([0-9.]+)", 1).cast("double").alias("value"), F.regexp_extract(m, r"([A-Za-z]+)$", 1).alias("unit")))
