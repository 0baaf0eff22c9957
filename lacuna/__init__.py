"""lacuna: evidence-first document analytics as Spark DataFrame programs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing in the library collects data to the driver.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
