"""Every operator as a query over the given tables, with the SQL it must agree with."""

from verification.registry import ORACLES, QUERIES  # noqa: F401
from verification import analytics, boards, logs, study  # noqa: F401,E402
