"""concord.sources"""
