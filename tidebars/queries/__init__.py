"""Every operator of the library applied to the driver's tables, with the SQL it is held against."""

from tidebars.queries import archives, bars, basics, feeds, functions, hours, indicators, models, regimes, research, warehouse

_MODULES = (archives, bars, basics, feeds, functions, hours, indicators, models, regimes, research, warehouse)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
