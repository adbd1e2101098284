"""Training-data operators: text tables in, tables out, one module per operator.

Nothing outside this package imports it; ``registry`` holds its queries and their SQL.
"""
