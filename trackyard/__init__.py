"""trackyard: set-based rail-operations analytics on PySpark.

Every operator takes DataFrames and returns DataFrames; nothing inside an
operator triggers an action.  See README.md for the operator inventory.
"""

__version__ = "0.1.0"
