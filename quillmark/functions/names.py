"""Author names: accent folding, particles, surnames, comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters without their accents.
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçšžøł"
FOLDED = "aaaaaaeeeeiiiiooooouuuuyyncszol"
PARTICLE = r"^(?:de la|van der|von der|de|di|da|du|van|von|der|den|del|della|la|le|el|al|bin|ibn)\s+"
COMPOUND = r"^((?:[Dd]i|[Dd]e|[Vv]an|[Vv]on|[Dd]er|[Dd]en|[Ll]a|[Ll]e|[Dd]el|[Dd]ella)\s+[\p{L}'-]+)"


def unaccented(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.translate(text, ACCENTED, FOLDED), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe"))


def normal_author(name: Column) -> Column:
    """Lower case, no accents, no leading particle, hyphens as blanks, no outer punctuation; null for null."""
    s = F.regexp_replace(unaccented(F.lower(F.trim(name))), PARTICLE, "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "-", " "), r"^[^a-z0-9]+|[^a-z0-9]+$", ""), r"\s+", " "))


def compound_surname(text: Column) -> Column:
    """First word, with its particle where it starts with one; null where there is no word."""
    compound = F.regexp_extract(text, COMPOUND, 1)
    word = F.regexp_extract(text, r"^([\p{L}'-]+)", 1)
    return F.when(F.length(compound) > 0, compound).when(F.length(word) > 0, word)


def names_match(a: Column, b: Column, threshold: float = 0.8) -> Column:
    """Whether two author names are the same: equal, contained, a few letters
    exchanged, or similar by edit distance; false where one is null or blank."""
    x, y = normal_author(a), normal_author(b)
    n, m = F.length(x), F.length(y)
    longest, shortest = F.greatest(n, m), F.least(n, m)
    exchanged = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (~p.eqNullSafe(q)).cast("int")), F.lit(0), lambda s, d: s + d)
    few = (n == m) & (exchanged <= F.when(n > 5, 2).otherwise(1))
    alike = (shortest / longest >= 0.7) & (1 - F.levenshtein(x, y) / longest >= threshold)
    same = (x == y) | x.contains(y) | y.contains(x) | few | alike
    return F.coalesce((n > 0) & (m > 0) & same, F.lit(False))


def letters_shared(a: Column, b: Column) -> Column:
    """Share of the distinct letters of two normalised names that both have."""
    x, y = (F.array_distinct(F.split(normal_author(c), "")) for c in (a, b))
    return F.round(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 4)
