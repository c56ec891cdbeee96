"""Search conditions as composable columns, chosen by the type of the field.

``Search(df)`` knows the schema. Its methods return columns that combine with
``&``, ``|`` and ``~``; fields the table does not have never match.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import text

_FLIPPED = {">=": "<", "<=": ">", ">": "<=", "<": ">="}


def _number(term) -> float | None:
    try:
        return float(term)
    except (TypeError, ValueError):
        return None


class Search:
    def __init__(self, df: DataFrame, implicit: Sequence[str] | None = None, text_fields: Sequence[str] | None = None):
        """``text_fields`` limits token search to indexed columns; ``implicit`` serves bare terms."""
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.text_fields = set(self.strings() if text_fields is None else text_fields)
        self.implicit = list(implicit) if implicit is not None else self.strings()

    def strings(self) -> list[str]:
        return [n for n, t in self.types.items() if isinstance(t, (T.StringType, T.VarcharType, T.CharType))]

    def _known(self, field: str) -> bool:
        return field in self.types

    @staticmethod
    def _signed(c: Column, negate: bool) -> Column:
        return ~c if negate else c

    def _scalar(self, field: str, term) -> Column | None:
        """Equality for booleans and numbers; None for other types."""
        kind = self.types[field]
        if isinstance(kind, T.BooleanType):
            word = str(term).strip().lower()
            return F.col(field) == F.lit(word == "true" or word == "1")
        if isinstance(kind, T.NumericType):
            n = _number(term)
            return text.never() if n is None else F.col(field) == F.lit(n)
        return None

    def term(self, field: str, term: str, prefix: bool = False, suffix: bool = False, negate: bool = False) -> Column:
        """``field:term``; ``suffix`` is a trailing wildcard and needs only a token prefix."""
        if not self._known(field):
            return text.never()
        scalar = self._scalar(field, term)
        if scalar is not None:
            return self._signed(scalar, negate)
        if not term:
            return F.lit(True)
        if field not in self.text_fields:
            return self._signed(text.contains_text(field, term, prefix, suffix), negate)
        matcher = text.match_phrase_prefix if suffix and not prefix else text.match_any
        return self._signed(matcher(field, term), negate)

    def phrase(self, field: str, phrase: str, negate: bool = False) -> Column:
        """``field:"a b"``: consecutive tokens, or equality for other types."""
        if not self._known(field):
            return text.never()
        scalar = self._scalar(field, phrase)
        if scalar is not None:
            return self._signed(scalar, negate)
        if field in self.text_fields:
            return self._signed(text.match_phrase(field, phrase), negate)
        return self._signed(F.col(field) == F.lit(phrase), negate)

    def exists(self, field: str, negate: bool = False) -> Column:
        """``field:*``: neither null nor empty."""
        if not self._known(field):
            return text.never()
        present = F.col(field).isNotNull()
        if field in self.strings():
            present = present & (F.col(field) != "")
        return self._signed(present, negate)

    def compare(self, field: str, op: str, value, negate: bool = False) -> Column:
        """``field:>=value``; a negated comparison is the opposite comparison."""
        if not self._known(field):
            return text.never()
        op = _FLIPPED[op] if negate else op
        left, right = F.col(field), F.lit(value).cast(self.types[field])
        if isinstance(self.types[field], T.NumericType):
            right = F.lit(_number(value))
        return {">=": left >= right, "<=": left <= right, ">": left > right, "<": left < right}[op]

    def between(self, field: str, low, high, negate: bool = False) -> Column:
        """``field:[low TO high]``, both ends inclusive, compared in the field's own type."""
        if not self._known(field):
            return text.never()
        kind = self.types[field]
        if isinstance(kind, T.NumericType):
            low, high = _number(low), _number(high)
        return self._signed(F.col(field).between(F.lit(low).cast(kind), F.lit(high).cast(kind)), negate)

    def anywhere(self, term: str, phrase: bool = False, prefix: bool = False, suffix: bool = False,
                 negate: bool = False) -> Column:
        """A bare term: OR over the implicit fields; negation wraps the whole OR."""
        fields = [f for f in self.implicit if self._known(f)]
        if phrase:
            fields = [f for f in fields if f in self.strings()]
        if not fields:
            return text.never()
        # Null in one field must not hide a hit in another, nor a miss in all of them.
        hits = [F.coalesce(self.phrase(f, term) if phrase else self.term(f, term, prefix, suffix), text.never())
                for f in fields]
        return self._signed(reduce(Column.__or__, hits), negate)

    def keywords(self, keywords: str, columns: Sequence[str]) -> Column:
        """Search-box text over indexed columns: quoted text is a phrase, numbers are compared."""
        words = keywords.strip()
        if not words:
            return F.lit(True)
        quoted = text.is_quoted(words)
        bare = words.strip("\"'")
        hits = []
        for name in columns:
            kind = self.types.get(name)
            if isinstance(kind, T.NumericType):
                n = _number(bare)
                hits.append(text.never() if n is None else F.col(name) == F.lit(n))
            elif isinstance(kind, T.StringType):
                hits.append(text.match_phrase(name, bare) if quoted else text.match_any(name, bare))
            elif isinstance(kind, T.ArrayType):
                match = text.match_phrase if quoted else text.match_any
                hits.append(F.exists(name, lambda x: match(x, bare)))
        return reduce(Column.__or__, [F.coalesce(h, text.never()) for h in hits]) if hits else text.never()
