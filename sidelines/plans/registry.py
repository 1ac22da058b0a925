"""Registers a query beside its SQL."""

from sidelines.plans.oracles import ORACLE_SQL
from sidelines.plans.queries import QUERIES


def query(sql: str | None = None):
    """Decorator: the function's name is the query's; without SQL, tests compare it with a plain restatement."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add
