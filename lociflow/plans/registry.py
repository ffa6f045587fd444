"""Registration of queries next to the SQL that states what they return."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable:
        """Register (spark, sf_dir) -> DataFrame under ``name``."""

        def keep(function: Callable) -> Callable:
            assert name not in self.queries, name
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return keep
