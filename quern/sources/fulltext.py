"""Full-text match: every query token must match; a word matches as a token's prefix, a quoted phrase as a part of the text.

Texts are cut at white space and tokens lose the marks at their ends, so "well-known" is one token.  Case is ignored.  A query
without tokens matches every row; the words of the query language itself are skipped.  A null text is empty.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the query language itself, which every row matches.
IGNORED = {"and", "or", "not", "near"}


def query_tokens(query: str) -> list[str]:
    """Words between spaces, and phrases with their quotes."""
    return re.findall(r'[^ "]*"[^"]*"|[^ ]+', query.strip().lower())


def match(text: Column, query: str) -> Column:
    """One native predicate for the whole query: a regular expression a word, which reads the text once and splits nothing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    tests = []
    for token in query_tokens(query):
        if token in IGNORED:
            continue
        if len(token) > 1 and token.startswith('"') and token.endswith('"'):
            tests.append(F.contains(low, F.lit(token[1:-1])))
        else:
            tests.append(_begins(low, token.removesuffix("*")))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _begins(low: Column, word: str) -> Column:
    if not word:
        return low.rlike(r"\S")
    if not word[0].isalnum():
        return F.lit(False)  # tokens begin with a letter or a digit
    escaped = "".join(c if c.isalnum() else "\\" + c if c.isascii() else c for c in word)
    more = "" if word[-1].isalnum() else r"\S*[\p{L}\p{N}]"  # marks at a token's end are not part of it
    return low.rlike(rf"(?:^|\s)[^\p{{L}}\p{{N}}\s]*{escaped}{more}")
