"""Named queries: each operator run over the driver's tables, with the SQL it is checked against."""

from . import registry  # noqa: F401
