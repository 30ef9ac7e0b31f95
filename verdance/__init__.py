"""Site and sample analytics on Spark: declarative operators over genotype tables."""

__version__ = "0.1.0"
