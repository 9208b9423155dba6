"""burstlake.plans"""
