"""routeloom.functions"""
