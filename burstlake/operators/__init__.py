"""burstlake.operators"""
