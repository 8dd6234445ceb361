"""prosewell.sources"""
