"""loomery: corpus and knowledge-graph analytics as Spark DataFrame operators."""
