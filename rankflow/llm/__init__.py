"""Training-data operators: one module each, registered in ``rankflow.llm.queries``.

Nothing outside this subpackage imports it; it uses only the general
session helpers of the library.
"""
