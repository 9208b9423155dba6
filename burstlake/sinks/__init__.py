"""burstlake.sinks"""
