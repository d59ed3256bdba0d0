"""chunkframe: chunked N-dimensional arrays as Spark tables."""
