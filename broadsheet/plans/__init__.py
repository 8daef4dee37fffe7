"""The engine's queries; importing the package registers all of them."""

from . import queries, articles, events, pages  # noqa: F401, I001  (queries first: the others use its pieces of SQL)
