"""adlens — ad-performance analytics expressed as Spark DataFrame jobs.

Every operator takes ``scope``: a list of grouping columns (for example
``["account_name"]``). ``scope=[]`` analyses the whole input as one advertiser;
a non-empty scope yields the same answer per advertiser in one distributed job.
"""

from adlens.session import get_spark, checkpoint_dir, materialize

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
