"""velarium: a semantic-layer analytics engine on Spark DataFrames."""

__version__ = "0.1.0"
