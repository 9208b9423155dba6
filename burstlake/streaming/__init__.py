"""burstlake.streaming"""
