"""A document-retrieval and knowledge-graph analytics engine on PySpark."""
