"""tidemark: retrieval, ingestion and corpus-preparation jobs on Spark DataFrames."""
