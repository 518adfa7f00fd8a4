"""gridscribe.functions"""
