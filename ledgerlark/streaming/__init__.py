"""ledgerlark.streaming"""
