"""chunkframe.sources"""
