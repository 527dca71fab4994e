"""logweave.sources"""
