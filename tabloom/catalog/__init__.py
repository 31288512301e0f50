"""Every registered query with its SQL counterpart, by topic."""

from tabloom.catalog import charts, cleaning, evaluation, modelling, preparation, profiles, rollups, scoring, sources
from tabloom.catalog.registry import QUERIES, SQL, Tables

__all__ = ["QUERIES", "SQL", "Tables", "charts", "cleaning", "evaluation", "modelling", "preparation", "profiles",
           "rollups", "scoring", "sources"]
