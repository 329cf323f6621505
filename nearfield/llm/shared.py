"""The shared folder's helpers, under the text operators' own name."""

from ..storage import get, opened, put, shared_dir, written

__all__ = ["get", "opened", "put", "shared_dir", "written"]
