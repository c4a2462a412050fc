"""Sources: driver tables, derived event views, delimited landing files, lookups."""

from .csv import CORRUPT, RAW_SCHEMA, load_raw_csv, write_raw_csv  # noqa: F401
from .fixtures import RAW_COLUMNS, fact_view, place_view, raw_view, short_rows, table  # noqa: F401
from .geo_lookup import city_coordinates, country_name_lookup  # noqa: F401
