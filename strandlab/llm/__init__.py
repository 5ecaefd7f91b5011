"""Training-data operators over document tables.

Nothing outside this subpackage imports it; the registry in
``strandlab.llm.registry`` lists its queries.
"""
