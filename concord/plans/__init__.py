"""concord.plans"""
