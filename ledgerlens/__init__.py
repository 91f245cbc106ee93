"""ledgerlens: Spark-native transaction forensics.

Every operator is a function ``op(df, *, cfg=Config(), by=("account_id",)) -> DataFrame``
that only builds a lazy plan.  Nothing is collected to the driver; all
per-statement statistics of a single-file tool become per-account statistics.
"""

from ledgerlens.config import Config

__all__ = ["Config"]
__version__ = "0.1.0"
