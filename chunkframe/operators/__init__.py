"""chunkframe.operators"""
