"""Retail sales, cost, profit and inventory analytics on Spark.

Every operator takes DataFrames (plus plain parameters) and returns a lazy
DataFrame.  Nothing is collected to the driver except values with a fixed
bound, such as validation counts.
"""
