"""Text predicates and small text transforms, all as built-in column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from tidemark.functions.fixed_values import ENTITY_NOISE, ENTITY_TYPES, SEPARATORS, STOP_WORDS

# A token starts and ends where no non-separator touches it.
_OTHER = f"[^{SEPARATORS[1:]}"
_END = f"(?!{_OTHER})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def never() -> Column:
    return F.lit(False)


def query_tokens(text: str) -> list[str]:
    """Tokens of a search parameter, by the same rule the column side uses."""
    return [t for t in re.split(f"{SEPARATORS}+", text.lower()) if t]


def tokens(c: Column | str) -> Column:
    """Lower-case tokens of a text column, in order, repeats kept."""
    return F.filter(F.split(F.lower(_col(c)), f"{SEPARATORS}+"), lambda t: t != "")


def _starting(word: str) -> str:
    """Pattern of a word at a token start; the letters come first, so that most positions fail at once."""
    return f"{word}(?<!{_OTHER}{word})"


def _has_words(c: Column | str, words: Sequence[str], pattern: str, any_word: bool = False) -> Column:
    """A byte search for the words first; the pattern decides only where they occur at all."""
    low = F.lower(_col(c))
    found = [low.contains(w) for w in dict.fromkeys(words)]
    return reduce(Column.__or__ if any_word else Column.__and__, found) & low.rlike(pattern)


def match_any(c: Column | str, query: str) -> Column:
    """At least one query token occurs as a whole token."""
    words = query_tokens(query)
    return _has_words(c, words, "|".join(_starting(w) + _END for w in words), any_word=True) if words else never()


def match_all(c: Column | str, query: str) -> Column:
    """Every query token occurs."""
    words = query_tokens(query)
    return reduce(Column.__and__, [match_any(c, w) for w in words]) if words else never()


def _phrase(words: Sequence[str]) -> str:
    first, rest = _starting(words[0]), [f"{SEPARATORS}+{w}" for w in words[1:]]
    return first + "".join(rest)


def match_phrase(c: Column | str, query: str) -> Column:
    """The query tokens occur consecutively."""
    words = query_tokens(query)
    return _has_words(c, words, _phrase(words) + _END) if words else never()


def match_phrase_prefix(c: Column | str, query: str) -> Column:
    """Like a phrase, but the last token only has to be a prefix."""
    words = query_tokens(query)
    return _has_words(c, words, _phrase(words)) if words else never()


def match_regexp(c: Column | str, pattern: str) -> Column:
    return _col(c).rlike(pattern)


MATCHERS = {
    "match": match_any,
    "match_any": match_any,
    "match_all": match_all,
    "match_phrase": match_phrase,
    "match_phrase_prefix": match_phrase_prefix,
    "match_regexp": match_regexp,
}


def contains_text(c: Column | str, term: str, prefix: bool = False, suffix: bool = False) -> Column:
    """Index-free test: wildcards become LIKE, several tokens need all tokens and the substring."""
    text = F.lower(_col(c))
    if prefix or suffix:
        return text.like(f"{'%' if prefix else ''}{term.lower()}{'%' if suffix else ''}")
    if re.search(SEPARATORS, term):
        return match_all(c, term) & text.contains(term.lower())
    return match_any(c, term)


def is_quoted(query: str) -> bool:
    return re.search(r"""(["'])(.*?)\1""", query) is not None


def highlight(c: Column | str, query: str) -> Column:
    """Wrap hits in <mark>: whole value, every phrase occurrence, or single tokens."""
    text = _col(c)
    if is_quoted(query):
        phrase = query.strip().strip("\"'")
        return (F.when(text == phrase, F.concat(F.lit("<mark>"), text, F.lit("</mark>")))
                .otherwise(F.replace(text, F.lit(phrase), F.lit(f"<mark>{phrase}</mark>"))))
    words = query_tokens(query)
    if not words:
        return text
    return F.regexp_replace(text, f"(?iu)({'|'.join(_starting(w) for w in words)}){_END}", "<mark>$1</mark>")


def entity_words(content: Column | str, n: int | None = None) -> Column:
    """The distinct capitalised words of more than four characters, the first ``n`` if given."""
    words = F.filter(F.split(_col(content), r"\s+"),
                     lambda w: (F.length(w) > 4) & w.rlike("^[A-Z]"))
    distinct = F.array_distinct(words)
    return distinct if n is None else F.slice(distinct, 1, n)


def extract_entities(content: Column | str, n: int = 8) -> Column:
    """``[{name, type}]`` with types assigned in turn."""
    kinds = F.array(*[F.lit(t) for t in ENTITY_TYPES])
    return F.transform(entity_words(content, n), lambda w, i: F.struct(
        F.regexp_replace(w, "[^a-zA-Z0-9]", "").alias("name"),
        F.element_at(kinds, (i % len(ENTITY_TYPES) + 1).cast("int")).alias("type")))


def extract_keywords(content: Column | str, n: int = 6) -> Column:
    """The first ``n`` distinct long lower-case words, reduced to ASCII letters."""
    words = F.filter(F.split(F.lower(_col(content)), r"\s+"), lambda w: F.length(w) > 5)
    return F.transform(F.slice(F.array_distinct(words), 1, n),
                       lambda w: F.regexp_replace(w, "[^a-z]", ""))


def query_terms(query: Column | str) -> Column:
    """Words of a question without stop words and very short words."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(_col(query)), r"\s+"),
                    lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def preview(content: Column | str, terms: Sequence[str] = (), n: int = 250) -> Column:
    """The first ``n`` characters with 【】 around the terms and an ellipsis when cut."""
    text = _col(content)
    shown = reduce(lambda acc, t: F.regexp_replace(acc, f"(?i)({re.escape(t)})", "【$1】"),
                   terms, F.substring(text, 1, n))
    return F.concat(shown, F.when(F.length(text) > n, "...").otherwise(""))


def clean_entities(names: Column | str, n: int | None = 12) -> Column:
    """Entity names without noise, first ``n`` distinct (all for None)."""
    kept = F.filter(_col(names), lambda e: F.length(e).between(3, 35) & ~e.rlike(ENTITY_NOISE))
    distinct = F.array_distinct(kept)
    return distinct if n is None else F.slice(distinct, 1, n)


def token_estimate(content: Column | str) -> Column:
    return F.ceil(F.length(_col(content)) / F.lit(4)).cast("long")
