"""Text scalars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character as the scorer sees it: Java's ``\w`` is ASCII only.
WORD = r"[\p{L}\p{N}_]+"
#: What ``str.split()`` splits at.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"

#: The words that are not indexed by the lexical ranker, and don't count as content of a question.
STOP_WORDS = (
    "a an the i i'm me my you your it its that this these those is am are was were be been do does did "
    "can could will would should may might have has had to of for in on at by with from about as if or and but so not no "
    "just still even also anything something really actually then than there here what how when where which who why"
).split()
#: Where a compound question is cut.
QUESTION_CUT = (
    r"(?i)(?<=[?.!])\s+|\s+[—–-]\s+"
    r"|,\s+(?:and\s+|but\s+|so\s+)?(?=(?:can|could|does|do|did|is|am|are|will|would|should|what|how)\b)"
)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of a value that is evaluated once, however often ``make`` uses it in its own lambdas."""
    return F.transform(F.array(value), make)[0]


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space and invisible characters."""
    return text.isNull() | text.rlike(r"^[\s\p{Z}\p{C}]*$")


def squeezed(text: Column) -> Column:
    """White space collapsed and trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def nfkc(text: Column) -> Column:
    """Compatibility composition, by the Unicode library that Spark brings along; texts of ASCII only are left as they are."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), composed).otherwise(text)


def words(text: Column) -> Column:
    """All words of the compatibility composition in lower case; null gives no words."""
    return F.regexp_extract_all(F.lower(nfkc(F.coalesce(text, F.lit("")))), F.lit(WORD), F.lit(0))


def norm_text(text: Column) -> Column:
    """The words joined by blanks with one at each end, so that a substring test is a whole-word test."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def quote_fragments(quote: Column) -> Column:
    """The normal forms of the parts of a quote between ellipses, without empty ones."""
    parts = F.split(F.coalesce(quote, F.lit("")), r"\.\.\.|…")
    return F.filter(F.transform(parts, norm_text), lambda x: F.trim(x) != "")


def date_int(text: Column) -> Column:
    """YYYYMMDD of an ISO date at the start of a text, else null."""
    found = F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    return F.when(found != "", F.regexp_replace(found, "-", "").cast("int"))


def index_tokens(text: Column, stop: list[str] = STOP_WORDS) -> Column:
    """The words without stop words."""
    return F.filter(words(text), lambda w: ~w.isin(stop))


def split_words(text: Column) -> Column:
    """The pieces between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(split_words(text))


def question_parts(question: Column, min_words: int = 4) -> Column:
    """The parts of a compound question; no parts unless two or more have enough words."""
    trimmed = F.transform(F.split(question, QUESTION_CUT), lambda p: F.regexp_replace(p, r"^[ ,;?]+|[ ,;?]+$", ""))
    parts = F.filter(trimmed, lambda p: word_count(p) >= min_words)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def is_vague(part: Column, min_content_words: int = 3) -> Column:
    """Whether a part has too few content words to be searched alone."""
    found = F.regexp_extract_all(F.lower(part), F.lit("[a-z']+"), F.lit(0))
    return F.size(F.filter(found, lambda w: ~w.isin(STOP_WORDS))) < min_content_words
