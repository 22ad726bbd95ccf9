"""tidemark: a small relational and corpus-processing engine built on PySpark."""
