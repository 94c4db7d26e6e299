"""corrolla.functions"""
