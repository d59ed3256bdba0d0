"""chunkframe.streaming"""
