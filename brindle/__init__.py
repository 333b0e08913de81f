"""brindle: matching and aligning labelled, hierarchical vocabularies on Spark."""

__version__ = "0.1.0"
