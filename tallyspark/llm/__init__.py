"""Training-data operators: thirteen corpus operations over documents and pages.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
only when it can be imported.
"""
