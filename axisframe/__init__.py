"""axisframe: annotated matrices as lazy Spark plans.

Sparse and dense matrices, and everything that describes their two axes, are held as DataFrames with explicit
ordinals.  Operators build plans only; ``collect``/``write`` are the actions.
"""

__version__ = "0.1.0"
