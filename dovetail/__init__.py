"""Record integration on Spark: extract, normalise, resolve, merge, score and project."""
