"""Payer-operations analytics as Spark DataFrame plans.

Every public function takes DataFrames (or a session and paths) and returns a
lazy DataFrame; nothing runs until the caller writes or collects the result.
"""
