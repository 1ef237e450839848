"""All registered queries of the mesh engine, and their SQL."""

from . import queries_brick, queries_elements, queries_files, queries_geometry, queries_model, queries_more, queries_parts, queries_quality, queries_tools, queries_topology

_PARTS = (queries_model, queries_topology, queries_geometry, queries_more, queries_files, queries_elements, queries_parts, queries_tools, queries_quality, queries_brick)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
