"""Small fixed lookup tables for the geographic datasets.

Both are hand-maintained dimension tables of tens of rows. They are joined to
per-city and per-country aggregates; Spark chooses the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Map-atlas country names -> event-table country names.
COUNTRY_NAME_MAP = {
    "United States of America": "United States",
    "United Kingdom": "United Kingdom",
    "United Arab Emirates": "United Arab Emirates",
    "Russian Federation": "Russia",
    "Republic of Korea": "South Korea",
    "Iran (Islamic Republic of)": "Iran",
}

# Coordinates of cities (country, city, lat, lng).
CITY_COORDINATES = [
    ("Argentina", "Buenos Aires", -34.61, -58.38),
    ("Australia", "Sydney", -33.87, 151.21),
    ("Australia", "Melbourne", -37.81, 144.96),
    ("Austria", "Vienna", 48.21, 16.37),
    ("Brazil", "Sao Paulo", -23.55, -46.63),
    ("Brazil", "Curitiba", -25.43, -49.27),
    ("Brazil", "Belo Horizonte", -19.92, -43.94),
    ("Brazil", "Joinville", -26.30, -48.85),
    ("Canada", "Toronto", 43.65, -79.38),
    ("Canada", "Vancouver", 49.25, -123.12),
    ("Canada", "Montreal", 45.50, -73.57),
    ("Canada", "Ottawa", 45.42, -75.69),
    ("China", "Beijing", 39.90, 116.41),
    ("China", "Shanghai", 31.23, 121.47),
    ("Denmark", "Copenhagen", 55.68, 12.57),
    ("France", "Paris", 48.86, 2.35),
    ("Germany", "Walldorf", 49.30, 8.65),
    ("Germany", "Berlin", 52.52, 13.40),
    ("Germany", "Frankfurt", 50.11, 8.68),
    ("Germany", "Munich", 48.14, 11.58),
    ("India", "Bengaluru", 12.97, 77.59),
    ("India", "Gurugram", 28.46, 77.03),
    ("India", "New Delhi", 28.61, 77.21),
    ("India", "Mumbai", 19.08, 72.88),
    ("India", "Ahmedabad", 23.03, 72.59),
    ("Indonesia", "Jakarta", -6.21, 106.85),
    ("Ireland", "Dublin", 53.33, -6.25),
    ("Israel", "Tel Aviv", 32.08, 34.78),
    ("Kenya", "Nairobi", -1.29, 36.82),
    ("Netherlands", "Amsterdam", 52.37, 4.90),
    ("Nigeria", "Lagos", 6.52, 3.38),
    ("Russia", "Moscow", 55.75, 37.62),
    ("Singapore", "Singapore", 1.35, 103.82),
    ("Sweden", "Stockholm", 59.33, 18.07),
    ("Sweden", "Gothenburg", 57.71, 11.97),
    ("United Arab Emirates", "Dubai", 25.20, 55.27),
    ("United Kingdom", "London", 51.51, -0.13),
    ("United Kingdom", "Edinburgh", 55.95, -3.19),
    ("United States", "SF Bay Area", 37.77, -122.42),
    ("United States", "Seattle", 47.61, -122.33),
    ("United States", "New York City", 40.71, -74.01),
    ("United States", "Boston", 42.36, -71.06),
    ("United States", "Chicago", 41.88, -87.63),
    ("United States", "Los Angeles", 34.05, -118.24),
    ("United States", "Phoenix", 33.45, -112.07),
    ("United States", "Miami", 25.77, -80.19),
    ("United States", "Atlanta", 33.75, -84.39),
    ("United States", "Austin", 30.27, -97.74),
]


def city_coordinates(spark: SparkSession) -> DataFrame:
    """(country, city, lat, lng) lookup."""
    return spark.createDataFrame(CITY_COORDINATES, "country string, city string, lat double, lng double")


def country_name_lookup(spark: SparkSession) -> DataFrame:
    """(external_name, internal_name) lookup."""
    return spark.createDataFrame(list(COUNTRY_NAME_MAP.items()), "external_name string, internal_name string")
