"""A Spark-native engine for large arrays that stay where they are.

Files, arrays and chunks are DataFrames; a chunk row says which file, offset and length
hold its encoded bytes. Queries prune chunk rows with Spark SQL, fetch and decode what is
left in Arrow workers, and hand cells to ordinary DataFrame operators.
"""
