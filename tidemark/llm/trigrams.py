"""Boolean trigram queries that a text must satisfy to match a regular expression.

A query is a disjunction of conjunctions: a set of frozensets of lower-case ASCII
trigrams, one of which must be contained in the text. None: no mandatory trigram.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

#: Alternatives of a query, and exact strings of a piece, beyond which it is no longer tracked.
MAX_ALTERNATIVES = 64

Query = frozenset[frozenset[str]] | None


def _grams(text: str) -> frozenset[str]:
    """Trigrams that cover the text: every third, and the last."""
    return frozenset(text[i : i + 3] for i in [*range(0, len(text) - 2, 3), len(text) - 3] if i >= 0)


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    made = frozenset(x | y for x in a for y in b)
    return made if len(made) <= MAX_ALTERNATIVES else a


def _query_of(strings: frozenset[str]) -> Query:
    """The query of a run of characters that is one of these strings."""
    grams = frozenset(_grams(s) for s in strings)
    return None if frozenset() in grams else grams


def _walk(pattern) -> tuple[frozenset[str] | None, Query]:
    """(all strings that the pattern matches, if few and known; its query)."""
    exact: frozenset[str] | None = frozenset([""])
    whole, query = True, None
    for op, value in pattern:
        strings, sub = None, None
        if op is sre.LITERAL and value < 128:
            strings = frozenset([chr(value).lower()])
        elif op is sre.SUBPATTERN:
            strings, sub = _walk(value[3])
        elif op is sre.BRANCH:
            ways = [_walk(w) for w in value[1]]
            if all(s is not None for s, _ in ways):
                strings = frozenset().union(*(s for s, _ in ways))
            queries = [q if s is None else _query_of(s) for s, q in ways]
            sub = None if any(q is None for q in queries) else frozenset().union(*queries)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            inner_strings, inner_query = _walk(inner)
            if least == 0 and most == 1 and inner_strings is not None:
                strings = inner_strings | {""}
            elif least >= 1:
                sub = inner_query if inner_strings is None else _query_of(inner_strings)
        if strings is not None and exact is not None and len(exact) * len(strings) <= MAX_ALTERNATIVES:
            exact = frozenset(a + b for a in exact for b in strings)
            continue
        # the run of known strings ends here
        if exact is not None:
            query = _both(query, _query_of(exact))
        whole = False
        if strings is not None:
            exact = strings
        else:
            query = _both(query, sub)
            exact = frozenset([""])
    if whole:
        return exact, _query_of(exact)
    return None, _both(query, _query_of(exact))


def trigram_query(pattern: str) -> list[list[str]] | None:
    """The pattern's query as sorted alternatives of sorted trigrams, or None."""
    _, query = _walk(parser.parse(pattern))
    return None if query is None else sorted(sorted(q) for q in query)
