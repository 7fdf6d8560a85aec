"""A small table of registered queries and their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def query(self, key: str, oracle: str | None = None):
        def register(function):
            self.queries[key] = function
            if oracle is not None:
                self.oracles[key] = oracle
            return function

        return register
