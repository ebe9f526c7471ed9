"""All registered queries."""

from tideline.queries import bars, features, flagship, joins, rules, scoring, tables, validation  # noqa: F401
from tideline.queries.base import REGISTRY  # noqa: F401
