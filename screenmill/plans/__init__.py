"""The registered queries over the given tables, with their SQL."""

from screenmill.plans import metrics, more, report, search, text  # noqa: F401
from screenmill.plans.registry import QUERIES, SQL  # noqa: F401
