"""corrolla.plans"""
