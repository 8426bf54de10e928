"""quayside: order-line analytics and classifiers as Spark jobs.

Every operator takes and returns DataFrames; the heavy work runs on the
executors and only model-sized tables (a few rows per class, per tree node
or per bin) ever reach the driver.
"""

__version__ = "0.1.0"
