"""routeloom.operators"""
