"""Spark-native analytics over Spark application telemetry.

Sub-packages
------------
functions   column expressions (no actions, no shuffles)
operators   DataFrame -> DataFrame operators that hold up under key skew
sources     tables, generators, landed monitoring JSON, Spark event logs
plans       telemetry tables, incremental store, diagnosis rules, report
streaming   Structured Streaming jobs
catalog     every registered query next to its SQL counterpart
"""
