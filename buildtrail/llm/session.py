"""Lineage cuts for iterative operators: those of the library."""

from buildtrail.lineage import checkpointed, shared_folder

__all__ = ["checkpointed", "shared_folder"]
