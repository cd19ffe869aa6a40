"""Rule materialization over RDF facts as Spark DataFrames, with operators for training-data pipelines in `llm`."""
