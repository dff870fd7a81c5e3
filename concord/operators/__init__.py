"""concord.operators"""
