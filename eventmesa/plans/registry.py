"""Every registered query of the library with the SQL that checks it."""

from . import attribution, equities, features, ingest, maintenance, models, options, reports, scoring, search, serving, validation

_PARTS = (equities, features, options, validation, serving, ingest, models, attribution, search, maintenance, reports, scoring)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: s for part in _PARTS for k, s in part.ORACLE_SQL.items()}
ORACLE_SQL["fama_macbeth"] = f"{features.FEATURES}, {validation.fama_sql()}"
