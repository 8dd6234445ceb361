"""prosewell.functions"""
