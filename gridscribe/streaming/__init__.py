"""gridscribe.streaming"""
