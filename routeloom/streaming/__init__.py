"""routeloom.streaming"""
