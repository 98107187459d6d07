"""Point-cloud grid analytics on Spark, with a subpackage of operators for training text."""
