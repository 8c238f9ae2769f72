"""Named queries over a folder of tables, each with the DuckDB SQL that must give the same rows where SQL can say it."""

from lumenta.queries import analytics, metrics, quality, retrieval, series, sql_surface, storage

MODULES = (metrics, sql_surface, analytics, series, quality, retrieval, storage)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
