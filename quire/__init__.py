"""quire: a Spark-first engine for document knowledge: parsing, concept graphs, integration and retrieval."""
