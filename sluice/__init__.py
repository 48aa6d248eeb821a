"""Gate-efficacy analytics on PySpark: admission gates, their statistics, and training-data operators."""
