"""burstlake.functions"""
