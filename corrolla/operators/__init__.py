"""corrolla.operators"""
