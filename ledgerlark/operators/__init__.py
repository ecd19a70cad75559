"""ledgerlark.operators"""
