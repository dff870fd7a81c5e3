"""concord.functions"""
