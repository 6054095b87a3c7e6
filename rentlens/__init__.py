"""rentlens: lease-risk analytics as Spark DataFrame operators."""
