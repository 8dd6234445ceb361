"""prosewell.operators"""
