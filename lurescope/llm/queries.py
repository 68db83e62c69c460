"""The queries of this subpackage and their SQL, for the entry module."""

from lurescope.llm import consensus, copies, groups, mixing, overlaps, packing, subjects
from lurescope.llm.oracle import SQL  # noqa: F401

QUERIES = {**consensus.QUERIES, **copies.QUERIES, **groups.QUERIES, **overlaps.QUERIES, **packing.QUERIES, **mixing.QUERIES, **subjects.QUERIES}

