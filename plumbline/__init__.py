"""Data-quality diagnosis, dimension profiling and behaviour analytics on Spark.

Every operator takes DataFrames and returns a DataFrame. Plans are built from
public DataFrame functions, so Catalyst optimises them and the work stays on
the executors.
"""

__version__ = "0.1.0"
