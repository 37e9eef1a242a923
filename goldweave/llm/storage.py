"""Intermediate tables of this subpackage: those of the library's shared folder."""

from goldweave.storage import discard, materialize, new_path, shared_dir

__all__ = ["discard", "materialize", "new_path", "shared_dir"]
