"""Named queries and the SQL that answers the same questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name that is not taken, with SQL for the same rows where SQL can say it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries of the name {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from tidewater.plans import check_queries, event_queries, graph_queries, link_queries, log_queries, model_queries, rank_queries, service_queries, table_queries, timeline_queries, value_queries  # noqa: E402, F401

#: Earlier names of whole queries.
for _new, _old in {
    "g_traverse": "g_traverse_all", "g_nodes_close": "g_nodes_close_all", "g_ownership": "g_ownership_all", "g_dep_edge": "g_dep_edge_tiers", "j_refmap": "j_refmap_all",
    "fn_month_range": "fn_month_range_all", "fn_csv_escape": "fn_csv_escape_all", "compact_row": "compact_row_all", "url_query_redact": "url_query_redact_keys",
}.items():
    query(_old, ORACLES[_new])(QUERIES[_new])
