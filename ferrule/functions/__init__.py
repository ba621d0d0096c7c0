"""ferrule.functions"""
