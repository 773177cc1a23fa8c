"""A PySpark-native engine for rare-event risk analytics and corpus preparation.

Every operator is a lazy function from DataFrames to a DataFrame; nothing here
starts a session on import.
"""
