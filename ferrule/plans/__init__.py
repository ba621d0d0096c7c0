"""ferrule.plans"""
