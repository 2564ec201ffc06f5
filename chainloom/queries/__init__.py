"""Registered queries over the driver's tables, and the same as SQL."""

from . import association, models, space, text

QUERIES = {**association.QUERIES, **space.QUERIES, **text.QUERIES, **models.QUERIES}
ORACLE = {**association.ORACLE, **space.ORACLE, **text.ORACLE, **models.ORACLE}
