"""gridscribe.operators"""
