"""A Spark-first SQL analytics engine: Catalyst plans, Tungsten runs."""
