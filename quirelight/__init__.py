"""quirelight: corpus search, cross-reference and curation operators on Spark DataFrames."""
