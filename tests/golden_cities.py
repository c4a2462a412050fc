"""Published city aggregates, the golden data of the map tests."""

from decimal import Decimal

from eventlens.sources.geo_lookup import CITY_COORDINATES

# Fixed values: (country, city, num_companies, total_laid_off, layoff_rate_raw in percent).
CITY_FIGURES = [
    ("Argentina", "Buenos Aires", 3, 233, 10.55),
    ("Australia", "Sydney", 10, 1078, 9.27),
    ("Australia", "Melbourne", 6, 369, 29.99),
    ("Austria", "Vienna", 1, 270, 27.00),
    ("Brazil", "Sao Paulo", 28, 5660, 10.75),
    ("Brazil", "Curitiba", 2, 462, 10.32),
    ("Brazil", "Belo Horizonte", 2, 327, 13.67),
    ("Brazil", "Joinville", 2, 191, 36.21),
    ("Canada", "Toronto", 30, 1643, 16.11),
    ("Canada", "Vancouver", 8, 945, 16.30),
    ("Canada", "Montreal", 8, 910, 16.72),
    ("Canada", "Ottawa", 1, 1000, 10.00),
    ("China", "Beijing", 1, 575, 24.21),
    ("China", "Shanghai", 1, 180, 9.00),
    ("Denmark", "Copenhagen", 2, 185, 74.00),
    ("France", "Paris", 3, 643, 26.62),
    ("Germany", "Walldorf", 1, 3000, 3.00),
    ("Germany", "Berlin", 25, 2869, 17.31),
    ("Germany", "Frankfurt", 1, 200, 4.00),
    ("Germany", "Munich", 2, 120, 20.00),
    ("India", "Bengaluru", 29, 14039, 9.67),
    ("India", "Gurugram", 9, 3776, 15.30),
    ("India", "New Delhi", 7, 900, 15.83),
    ("India", "Mumbai", 7, 745, 14.63),
    ("India", "Ahmedabad", 1, 500, 50.00),
    ("Indonesia", "Jakarta", 8, 2721, 11.41),
    ("Ireland", "Dublin", 3, 236, 26.22),
    ("Israel", "Tel Aviv", 32, 2215, 12.92),
    ("Kenya", "Nairobi", 3, 349, 16.05),
    ("Netherlands", "Amsterdam", 1, 225, 25.00),
    ("Nigeria", "Lagos", 4, 970, 18.10),
    ("Russia", "Moscow", 1, 400, 40.00),
    ("Singapore", "Singapore", 15, 3795, 13.34),
    ("Sweden", "Stockholm", 6, 10370, 8.06),
    ("Sweden", "Gothenburg", 1, 72, 33.00),
    ("United Arab Emirates", "Dubai", 4, 995, 27.19),
    ("United Kingdom", "London", 27, 5005, 18.74),
    ("United Kingdom", "Edinburgh", 1, 300, 20.00),
    ("United States", "SF Bay Area", 248, 109168, 9.18),
    ("United States", "Seattle", 28, 33936, 3.47),
    ("United States", "New York City", 108, 21727, 15.38),
    ("United States", "Boston", 43, 8983, 12.13),
    ("United States", "Chicago", 20, 5530, 16.49),
    ("United States", "Los Angeles", 36, 5034, 17.37),
    ("United States", "Phoenix", 3, 4625, 9.81),
    ("United States", "Miami", 4, 1877, 10.26),
    ("United States", "Atlanta", 6, 1665, 16.20),
    ("United States", "Austin", 12, 939, 15.81),
]

SCHEMA = "country string, city string, num_companies int, total_laid_off int, layoff_rate_raw decimal(10,2), lat double, lng double"


def city_rows(spark):
    at = {(a, b): (lat, lng) for a, b, lat, lng in CITY_COORDINATES}
    return spark.createDataFrame([(a, b, n, t, Decimal(f"{x:.2f}"), *at[a, b]) for a, b, n, t, x in CITY_FIGURES], SCHEMA)
