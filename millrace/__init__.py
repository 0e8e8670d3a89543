"""millrace: document-corpus, retrieval and evaluation operators written for Spark DataFrames."""
