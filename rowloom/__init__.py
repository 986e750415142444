"""rowloom: schema-declared, ordered row batches on Spark DataFrames."""
