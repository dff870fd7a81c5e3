"""concord: evaluation analytics for labelled text corpora on Spark."""

__version__ = "0.1.0"
