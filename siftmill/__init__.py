"""Source-corpus analytics on Spark: detectors, facts, metrics, clones and findings reports as DataFrame plans."""

__version__ = "0.1.0"
