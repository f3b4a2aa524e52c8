"""Dataset profiling, feature building, validation and forecasting as Spark DataFrame functions."""

__version__ = "0.1.0"
