"""Quality control of observations on Spark."""

__version__ = "0.1.0"
