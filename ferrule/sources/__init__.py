"""ferrule.sources"""
