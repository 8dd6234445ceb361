"""prosewell.streaming"""
