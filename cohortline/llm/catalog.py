"""All registered queries of this subpackage, each next to its SQL where there is one."""

from __future__ import annotations

from cohortline.llm import (  # noqa: F401
    bpe,
    chat,
    codes,
    embeddings,
    licenses,
    mixing,
    parsing,
    passages,
    secret_scan,
    simhash,
    token_file,
    toxicity,
    trie,
)
from cohortline.llm.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)
