"""evstat: Spark-native statistics over large event tables.

Every public function takes and returns Spark DataFrames (or MLlib
objects) and runs on the caller's SparkSession.  Nothing here sets the
master or pulls data-sized results to the driver.
"""

__version__ = "0.1.0"
