"""ledgerlark.sources"""
