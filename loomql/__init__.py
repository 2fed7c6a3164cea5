"""loomql: a query builder, writes and governance over Spark. The training-data
operators of `loomql.llm` stand beside it, and nothing here imports them."""
