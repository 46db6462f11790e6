"""tessera: Spark-native preparation, featurisation and valuation of labelled text and tables.

Every public function takes and returns a ``pyspark.sql.DataFrame`` (or a Column
expression); nothing whole is pulled to the driver except fixed-size aggregates
and model parameters.
"""

__version__ = "0.1.0"
