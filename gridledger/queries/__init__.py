"""Every operator of the library, bound to the driver's tables. Importing this package fills gridledger.registry."""

from gridledger.queries import aggregates, documents, facts, files, graphs, joins, lifecycle, scalars, windows  # noqa: F401
