"""burstlake.sources"""
