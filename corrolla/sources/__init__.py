"""corrolla.sources"""
