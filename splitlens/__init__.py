"""splitlens: a Spark-native engine for two-arm product experiments over clickstream tables.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions; nothing in the data path runs Python per row.
"""

__version__ = "0.1.0"
