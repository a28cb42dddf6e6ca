"""Opinion analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; grouping keys are
parameters, so one call covers all projects, surveys and periods at once.
"""
