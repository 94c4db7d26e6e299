"""corrolla.streaming"""
