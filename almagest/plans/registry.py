"""All queries on the driver's tables, by name, and the SQL each must equal."""

from almagest.plans import datasets, evaluation, evidence, graphs, products, relational, scans, snapshots

_MODULES = (snapshots, products, relational, graphs, evaluation, evidence, scans, datasets)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
