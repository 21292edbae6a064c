"""wardlake: clinic operations analytics on Spark.

Operators take DataFrames and explicit ``as_of`` dates and return DataFrames;
an optional ``tenant`` key (``("clinic_id",)``) runs them over many clinics
in one job. See README.md for the layout and the design for scale.
"""

__version__ = "0.1.0"
