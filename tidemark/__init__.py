"""Commerce, observability and retrieval analytics written as plain Spark jobs.

Every operator is a function from DataFrames (plus parameters) to a DataFrame.
Nothing is executed until the caller writes, streams or collects the result.
"""
