"""Leaves of nested JSON as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.functions import udtf

SKIPPED = frozenset(("category", "source_span", "summary_statement"))


@udtf(returnType="path string, value string")
class Leaves:
    """path (a.b[0].c) and value of every string leaf of a JSON text; some keys are skipped with all below them."""

    def eval(self, raw: str) -> Iterator[tuple[str, str]]:
        import json

        def walk(x: object, path: str) -> Iterator[tuple[str, str]]:
            if isinstance(x, dict):
                for k, v in x.items():
                    if k not in SKIPPED:
                        yield from walk(v, f"{path}.{k}" if path else k)
            elif isinstance(x, list):
                for i, v in enumerate(x):
                    yield from walk(v, f"{path}[{i}]")
            elif isinstance(x, str) and x.strip():
                yield path, x

        yield from walk(json.loads(raw or "null"), "")
