"""Where queries register with the SQL that they are held against."""

from __future__ import annotations

from factweave.plans.corpus_graph import GRAPH_SQL, Corpus

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, over_graph: bool = True):
    """Register a function of a Corpus under its name; ``sql`` follows the common table expressions of the graph, or stands alone."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = (GRAPH_SQL if over_graph else "") + sql
        return f

    return add
