"""Operators for preparing language-model training data at corpus scale.

Nothing outside this package imports it.  Every operator takes DataFrames and
returns a DataFrame; :mod:`wavegrid.llm.registry` wires them to the named
queries.
"""
