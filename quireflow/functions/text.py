"""Column helpers for text, numbers and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[\\p{L}\\p{N}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: str | Column) -> Column:
    """The value as a generator's only row, so that later expressions read it and don't compute it again."""
    return F.explode(F.array(col(c)))


def tokens(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def fold(c: str | Column) -> Column:
    """Lower case, white space folded to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "\\s+", " "))


def normalize(c: str | Column) -> Column:
    """Lower case, everything but letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^\\p{L}\\p{N}]+", " "))


def grams(c: str | Column, n: int) -> Column:
    """Distinct character n-grams; a shorter text has none."""
    c = col(c)
    return F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: c.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def word_runs(words: Column, n: int) -> Column:
    """Distinct runs of n words joined by a blank; fewer words have none."""
    return F.when(
        F.size(words) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))),
    ).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two sets; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def hits(c: str | Column, words: list[str]) -> Column:
    """How many of the given phrases occur in the text."""
    return sum((F.when(F.contains(col(c), F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def sentences(c: str | Column) -> Column:
    """Trimmed pieces between sentence ends and line breaks, empty ones left out; a full stop before a digit ends none."""
    parts = F.split(F.coalesce(col(c), F.lit("")), "(?:[!?\\n。！？]|\\.(?![0-9]))+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def dot(a: str | Column, b: str | Column) -> Column:
    both = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; 0 for different lengths or a zero vector."""
    a, b = col(a), col(b)
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def uniform(c: str | Column, salt: str = "") -> Column:
    """A number in [0, 1) from md5, the same on every engine and run."""
    head = F.substring(F.md5(F.concat(F.lit(salt), col(c).cast("string"))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / 4294967296.0


def number(c: str | Column) -> Column:
    """A number from text with thousands commas, a percent sign or an exponent; null where it is none. '84.6%' is 84.6."""
    return F.trim(F.regexp_replace(col(c), "[,%]", "")).try_cast("double")


def clamped(c: str | Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Text or number within bounds; what isn't a number is the middle."""
    value = col(c).cast("string").try_cast("double")
    return F.when(value.isNull(), F.lit((low + high) / 2)).otherwise(clamp(value, low, high))


def floats(c: str | Column) -> Column:
    """The numbers of a list of texts, the entries that aren't one left out; a null list is empty."""
    values = F.transform(col(c), lambda x: x.cast("string").try_cast("double"))
    return F.coalesce(F.filter(values, lambda x: x.isNotNull()), F.array().cast("array<double>"))


def vector_to_json(c: str | Column) -> Column:
    return F.to_json(col(c))


def vector_from_json(c: str | Column) -> Column:
    """A vector from a JSON list of numbers or of texts of numbers; anything else, an entry that is no number included, is empty."""
    raw = F.from_json(col(c), "array<string>")
    values = F.transform(raw, lambda x: x.try_cast("double"))
    bad = raw.isNull() | F.exists(values, lambda x: x.isNull())
    return F.when(bad, F.array().cast("array<double>")).otherwise(values)


def cut_at_sentence(c: str | Column, most: int = 4000) -> Column:
    """The first `most` characters of a longer text, up to the last sentence end beyond .7 of them, else the last comma beyond .6, else with an ellipsis; null is empty."""
    c = F.coalesce(col(c), F.lit(""))
    head = F.substring(c, 1, most)
    last = lambda marks: most - F.length(F.regexp_extract(head, f"([^{marks}]*)$", 1))  # noqa: E731  the place of the last mark, from 1
    stop, comma = last("。！？"), last("，,、")
    cut = F.when(stop - 1 > most * 0.7, F.substring(c, F.lit(1), stop)).when(comma - 1 > most * 0.6, F.substring(c, F.lit(1), comma)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(c) <= most, c).otherwise(cut)
