"""routeloom.sources"""
