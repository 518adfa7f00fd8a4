"""gridscribe.sources"""
