"""replenix — stock-replenishment analytics on Spark DataFrames.

Demand windows after restocks (P1), stock / purchase-order / demand assembly
and order-expedite-hold decisions (P2) over all channels in one job (P3),
views and aggregates, data-quality checks, sinks and a streaming scan.
"""

__version__ = "0.1.0"

from .plans.replenishment import demand, replenishment  # noqa: E402,F401
from .session import build_session  # noqa: E402,F401
