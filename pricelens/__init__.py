"""pricelens: competitor price-monitoring analytics as PySpark DataFrame functions.

Every public function maps DataFrames (and Column expressions) to DataFrames,
vectorised over all users / products / competitors at once.  Time-dependent
logic takes an explicit ``as_of`` instead of reading the wall clock, so runs are
reproducible and can be replayed.
"""

__version__ = "0.1.0"
