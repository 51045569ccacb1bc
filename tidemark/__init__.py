"""Time-series analytics on Spark DataFrames.

A metric name plus nullable string labels identify a series; samples sit on a fixed
interval grid.  Everything here builds logical plans; Catalyst picks the physical ones.
"""
