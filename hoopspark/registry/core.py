"""Collecting registered queries."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            if name in self.queries:
                raise ValueError(f"duplicate query {name}")
            self.queries[name] = fn
            if sql:
                self.oracle[name] = sql
            return fn
        return add


query = Registry()
