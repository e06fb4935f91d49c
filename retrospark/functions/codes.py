"""Code-column predicates and tokenisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CODE_TOKEN_PATTERN, INDEX_CODE_PATTERN


def q(name: str) -> Column:
    """Column by exact physical name (names may hold ``:`` or non-ASCII letters)."""
    return F.col(f"`{name}`")


def code_match(column: str, pattern: str = INDEX_CODE_PATTERN) -> Column:
    """Contains-test of a regex on a string column; null -> false."""
    return F.coalesce(q(column).cast("string").rlike(pattern), F.lit(False))


def any_code_match(columns: list[str], available: list[str], pattern: str = INDEX_CODE_PATTERN) -> Column:
    """OR of :func:`code_match` over the code columns that exist (absent columns ignored)."""
    expr = F.lit(False)
    for c in columns:
        if c in available:
            expr = expr | code_match(c, pattern)
    return expr


def code_tokens(column: str) -> Column:
    """Ordered distinct code tokens of an upper-cased text column (array, null when none)."""
    tokens = F.array_distinct(F.regexp_extract_all(F.upper(q(column).cast("string")), F.lit(CODE_TOKEN_PATTERN), 1))
    return F.when(F.size(tokens) > 0, tokens)


def normalized_codes(column: str) -> Column:
    """Tokens joined with ``;`` (null when the text is null or has no token)."""
    return F.array_join(code_tokens(column), ";")
