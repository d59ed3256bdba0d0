"""chunkframe.functions"""
