"""logweave.operators"""
