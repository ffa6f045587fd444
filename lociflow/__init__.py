"""Spark-native sequence quality-control analytics.

Every operator is a function from DataFrames to a DataFrame.  The packages are
``functions`` (column expressions), ``sources`` (readers and sinks),
``operators`` (relational operators), ``plans`` (registered queries with their
SQL), ``streaming`` (Structured Streaming forms) and ``llm`` (operators for
training data, which nothing else imports).
"""
