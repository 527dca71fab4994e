"""logweave.plans"""
