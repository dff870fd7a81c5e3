"""concord.streaming"""
