"""The operators registered over the driver's tables, with their SQL oracles."""

from stayline.workload import cohorts, modelling, profiling, relational, textual  # noqa: F401
from stayline.workload.registry import ORACLES, QUERIES  # noqa: F401
