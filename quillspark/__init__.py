"""Sequence analytics on Spark: signal features, Gaussian models, trellis decoding, scoring."""
