"""All queries of this package."""

from __future__ import annotations

from clientele.llm import (  # noqa: F401  (register)
    queries_chat, queries_collocations, queries_divergence, queries_licences, queries_lines, queries_mix,
    queries_pages, queries_quality, queries_repeats, queries_simhash, queries_suffix, queries_tokens, queries_urls)
from clientele.llm.registry import RUNS, SQL, Run


def runs() -> dict[str, Run]:
    return dict(RUNS)


def oracle() -> dict[str, str]:
    return dict(SQL)
