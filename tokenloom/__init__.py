"""tokenloom: token-sequence and tensor-as-table analytics on Spark DataFrames."""
