"""Quern: a Spark-first engine for labelling source-code repositories."""
