"""viewlens: Spark-native analytics over viewing histories.

Every public function maps DataFrame(s) to a DataFrame and is built from
Spark's built-in operators, so Catalyst and adaptive execution do the
planning. See README.md for the operator map.
"""

__version__ = "0.1.0"
