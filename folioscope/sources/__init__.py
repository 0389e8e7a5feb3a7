"""folioscope.sources"""
