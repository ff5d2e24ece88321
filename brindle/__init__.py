"""A Spark-first analytics engine for stochastic simulation data."""

__version__ = "0.1.0"
