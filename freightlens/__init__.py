"""freightlens: shipment and GPS analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession and a path) and
returns lazy DataFrames; nothing is collected to the driver except the few
fitted models and small thresholds that Spark ML itself needs.
"""

__version__ = "0.1.0"
