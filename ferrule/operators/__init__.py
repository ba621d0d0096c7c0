"""ferrule.operators"""
