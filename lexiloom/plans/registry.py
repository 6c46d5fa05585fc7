"""All registered queries of the core library and their DuckDB counterparts."""

from __future__ import annotations

from . import base, glyph, other, text  # noqa: F401  importing registers


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracles() -> dict[str, str]:
    return dict(base.ORACLES)
