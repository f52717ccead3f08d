"""Training-data operators on Spark.

Ten operators over ``documents`` and ``pages`` tables, one module each. Nothing
outside this subpackage imports it; it needs only PySpark, numpy, pyarrow and,
where a module says so, a tokenizer or hashing library.
"""
