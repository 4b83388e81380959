"""The registered queries. Importing this package fills the registry."""

from inkwell.plans.catalog import answers, monitor, prepare  # noqa: F401
from inkwell.plans.catalog.registry import ORACLES, QUERIES  # noqa: F401
