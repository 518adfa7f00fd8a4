"""gridscribe.plans"""
