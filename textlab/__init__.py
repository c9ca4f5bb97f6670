"""textlab: corpus-scale text analytics for simplification corpora on Spark.

Every operator is a DataFrame -> DataFrame (or Column -> Column) function built
from Spark SQL expressions, aggregations and windows.  See README.md.
"""

__version__ = "0.1.0"
