"""prosewell.plans"""
