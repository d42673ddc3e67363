"""One listing per table and query.

While a query is built, every part of it that reads a table shares one DataFrame, so that
the files of a large table are listed, and their schema is read, once and not once per use.
Nothing outlives the building of the query: the next one sees files that were added since.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

T = TypeVar("T")

_memo: ContextVar[dict | None] = ContextVar("memo", default=None)


@contextmanager
def building() -> Iterator[None]:
    """Scope of one query."""
    token = _memo.set({})
    try:
        yield
    finally:
        _memo.reset(token)


def once(key: Hashable, make: Callable[[], T]) -> T:
    """The value made for the key earlier in this scope, or a new one."""
    memo = _memo.get()
    if memo is None:
        return make()
    if key not in memo:
        memo[key] = make()
    return memo[key]
