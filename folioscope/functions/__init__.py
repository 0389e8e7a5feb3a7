"""folioscope.functions"""
