from quarry.sources.tables import TABLES, Tables, load
from quarry.sources.views import VIEWS, Views

__all__ = ["TABLES", "Tables", "load", "VIEWS", "Views"]
