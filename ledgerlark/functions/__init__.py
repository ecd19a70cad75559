"""ledgerlark.functions"""
