"""convkit: dialogue-corpus analytics as Spark DataFrame jobs.

Every public function is either ``DataFrame -> DataFrame`` or
``Column -> Column``; nothing in the library collects data to the driver.
"""

from convkit.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
