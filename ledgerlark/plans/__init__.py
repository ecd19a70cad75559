"""ledgerlark.plans"""
