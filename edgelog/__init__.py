"""edgelog: Spark-native analytics for a content-delivery site's edge logs,
operations metrics, rule classification, event shaping and log stitching.

Every operator is a DataFrame -> DataFrame function built from Spark SQL
column expressions; nothing is collected to the driver.
"""

__version__ = "0.1.0"
