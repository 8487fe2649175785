"""All registered queries."""

from modlens.catalog.base import ORACLE, QUERIES
from modlens.catalog import corpus, evaluation, files, jobs, reports, text  # noqa: F401
from modlens.catalog.flagship import flagship  # noqa: F401
