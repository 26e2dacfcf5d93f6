"""Named queries over the standard tables and the SQL they are checked against."""

from cropmill.plans import core, extras, more, reports

QUERIES = core.QUERIES | reports.QUERIES | extras.QUERIES | more.QUERIES
ORACLE_SQL = core.ORACLE_SQL | reports.ORACLE_SQL | extras.ORACLE_SQL | more.ORACLE_SQL
