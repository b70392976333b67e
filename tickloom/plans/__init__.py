"""One query for each market operator, over whole tables, with its SQL."""

from . import feeds, queries  # noqa: F401  (feeds registers its queries with queries)
