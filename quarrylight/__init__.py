"""Spark-first evidence and text analytics.

Every operator takes and returns DataFrames.  Plans are declared with the
DataFrame API; the physical strategy is left to Catalyst and AQE.
"""
