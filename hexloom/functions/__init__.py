"""hexloom.functions"""
