"""tidewire: a Spark-first analytics engine for news signals and text corpora."""
