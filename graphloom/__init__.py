"""graphloom: a PySpark-native engine for text-attributed graphs and their search agents.

Sub-packages
------------
functions   Column expressions (text, vector, reward and metric formulas)
operators   DataFrame -> DataFrame operators (graph, retrieval, sampling, rollouts)
sources     readers and writers
plans       the registered queries and their SQL twins
streaming   Structured Streaming jobs
"""

__version__ = "0.1.0"


def _travel_by_value() -> None:
    """Functions of this package go to the executors by value, so it need not be installed there."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_travel_by_value()
