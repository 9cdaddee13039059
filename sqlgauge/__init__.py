"""sqlgauge: a Spark-native engine for benchmarking generated SQL at scale.

Every public function takes and returns DataFrames (or Column expressions);
the heavy work runs as Spark jobs, never on the driver.
"""

__version__ = "0.1.0"
