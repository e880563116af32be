"""Scalar text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Words left out of support tokens.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "that", "the", "their", "this", "to", "with")
#: Words left out of title keywords.
TITLE_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "for", "from", "how", "in", "is", "of", "on", "or", "the", "to", "under", "when", "with")
#: Words that negate.
NEGATIONS = ("no", "not", "never", "without", "unless", "neither", "nor", "cannot", "can't", "mustn't", "prohibit", "prohibited", "prohibits", "ban", "banned", "except", "exempt", "exemption")

BLANKS = " \t\n\r\x0b\x0c"


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(c) -> Column:
    """Without ASCII blanks at both ends."""
    return F.regexp_replace(c, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def squeeze(c) -> Column:
    """Every run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\x0B\f]+", " "))


def slug(c) -> Column:
    """Lower-case letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def plain(c) -> Column:
    """Lower-case text reduced to letters, digits and ``%.,'``."""
    text = F.regexp_replace(F.lower(c), r"[ \t\n\r\x0B\f]+", " ")
    return squeeze(F.regexp_replace(text, r"[^a-z0-9%.,' ]+", " "))


def tokens(c, drop=STOPWORDS) -> Column:
    """Words of a plain text, repeats kept, without the ``drop`` words."""
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*drop)) if drop else found


def keywords(c) -> Column:
    """Distinct words of three letters or more that are no title stop-word."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*TITLE_STOPWORDS)))


def numbers(c) -> Column:
    """Distinct numbers of a text, with a decimal point."""
    found = F.regexp_extract_all(c, F.lit(r"\b\d+(?:[.,]\d+)?%?\b"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def count_in(array, values) -> Column:
    return F.size(F.filter(array, lambda t: t.isin(*values)))


def jaccard(a, b) -> Column:
    """Shared over all distinct elements; 0 if either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(candidate, evidence) -> Column:
    """Share of the candidate's tokens, counted with repeats, that the evidence has too."""
    times = lambda array, t: F.size(F.filter(array, lambda x: x == t))
    shared = F.aggregate(F.array_distinct(candidate), F.lit(0), lambda acc, t: acc + F.least(times(candidate, t), times(evidence, t)))
    return F.when(F.size(candidate) == 0, F.lit(0.0)).otherwise(shared / F.size(candidate))


def ngrams(array, n: int) -> Column:
    """Runs of ``n`` elements, joined by a space."""
    starts = F.sequence(F.lit(1), F.size(array) - (n - 1))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(array, i, n), " "))
    return F.when(F.size(array) >= n, grams).otherwise(F.array().cast("array<string>"))


def is_heading(line) -> Column:
    """At most 120 characters, not ending like a sentence, numbered or in title case."""
    words = F.filter(F.split(line, " "), lambda w: w != "")
    capitals = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    titled = (F.size(words) >= 2) & (F.size(words) <= 12) & ~F.exists(words, lambda w: w.rlike("^[0-9]+$")) & (capitals >= F.greatest(F.lit(2), F.size(words) - 1))
    return (F.length(line) <= 120) & (F.length(line) > 0) & ~line.rlike("[.?!;:]$") & (line.rlike(r"^[0-9]+(\.[0-9]+)*[.)]? +[A-Z]") | titled)
