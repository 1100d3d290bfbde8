"""String and token-set expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG_LENGTH = 64
#: What separates tokens: anything neither alphabetic nor numeric.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def content_hash(text: Column) -> Column:
    """The upper 64 bits of md5, as an unsigned decimal."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens, at most 64 long, or ``untitled``.

    Only A-Z are folded: characters that other locales fold into ASCII are separators.
    """
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    joined = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-", "")
    cut = F.regexp_replace(F.substring(joined, 1, SLUG_LENGTH), "-+$", "")
    return F.when(text.isNotNull(), F.coalesce(F.nullif(cut, F.lit("")), F.lit("untitled")))


def trim_end(text: Column) -> Column:
    """Without trailing Unicode white space."""
    return F.regexp_replace(text, r"(?U)\s+\z", "")


def blank(text: Column) -> Column:
    """Whether nothing but Unicode white space is there."""
    return ~text.rlike(r"(?U)\S")


def tokens(text: Column) -> Column:
    """The set of lower-cased alphanumeric runs."""
    return F.array_distinct(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Resemblance of two sets as a double; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both.cast("double") / (F.size(a) + F.size(b) - both).cast("double"))
