"""routeloom.plans"""
