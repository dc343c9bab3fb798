"""strandline: a PySpark engine that turns entity lists, pages and notes into validated graph rows.

Every operator is a function from DataFrames to a DataFrame; nothing here loops over rows on the
driver. ``strandline.llm`` holds the operators for training text and is imported by nothing else.
"""
