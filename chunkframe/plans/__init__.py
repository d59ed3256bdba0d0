"""chunkframe.plans"""
