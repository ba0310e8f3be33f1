"""Connected components of a link table: those of the core."""

from lectern.operators.links import components  # noqa: F401
