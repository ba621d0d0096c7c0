"""ferrule.streaming"""
