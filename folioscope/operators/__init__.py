"""folioscope.operators"""
