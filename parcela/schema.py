"""Listing columns, code tables and the feature list of the price model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Codes and labels used by the listing portal. They must stay exactly as they
# are: stored data is keyed by the labels.
OPERATION_LABELS = {
    1: "Venta",
    2: "Arriendo",
}
PROPERTY_LABELS = {
    1: "Casa",
    2: "Apartamento",
    3: "Lote",
    4: "Local",
    5: "Oficina",
    6: "Finca",
    8: "Parqueadero",
    9: "Consultorio",
    10: "Edificio",
    14: "Apartaestudio",
    15: "Cabaña",
    16: "Casa Campestre",
    17: "Casa Lote",
    18: "Habitación",
    19: "Bodega",
}
ANTIQUITY_LABELS = {
    1: "Menor a 1 año",
    2: "De 1 a 8 años",
    3: "De 9 a 15 años",
    4: "De 16 a 30 años",
    5: "Más de 30 años",
}
SOURCE_NAME = "Finca Raiz"
LINK_PREFIX = "https://www.fincaraiz.com.co"
ROWS_PER_PAGE = 32
BATCH_ID_FORMAT = "yyyy-MM-dd_HH-mm-ss"
# --- End of fixed values ----------------------------------------------------

OPERATIONS = ["Arriendo", "Venta"]
APARTMENT_TYPES = ["Apartamento", "Apartaestudio"]
CAPPED_FIELDS = ["BUILT_AREA", "AREA", "GARAGE", "BATHROOMS", "ROOMS"]


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(n, kind) for n in names.split()]


# Columns of a flattened listing, in the order flatten_listings returns them.
LISTING_COLUMNS = (
    "SOURCE WEB_PROPERTY_CODE PRICE PRICE_ADMIN_INCLUDED AREA LATITUDE LONGITUDE "
    "ANTIQUITY CONSTRUCTION_YEAR BUILT_AREA PRIVATE_AREA GARAGE BATHROOMS ROOMS FLOOR "
    "PROPERTY_TYPE OPERATION_TYPE STRATUM BEDROOMS DESCRIPTION LINK"
).split()

# A stored page. Values the portal sends both as numbers and as text are read
# as text and coerced afterwards, so a quoted number is not lost.
PAGE = T.StructType([
    T.StructField("hits", T.StructType([
        T.StructField("total", T.StructType([T.StructField("value", T.LongType())])),
        T.StructField("hits", T.ArrayType(T.StructType([
            T.StructField("_source", T.StructType([
                T.StructField("listing", T.StructType(
                    _fields(T.StringType(), "id")
                    + [T.StructField("price", T.StructType(
                        _fields(T.StringType(), "amount admin_included")))]
                    + _fields(
                        T.StringType(),
                        "m2 latitude longitude antiquity construction_year m2Built m2apto garage "
                        "bathrooms rooms floor property_type_id operation_type_id stratum "
                        "bedrooms description link",
                    )
                )),
            ])),
        ]))),
    ])),
])

# Stored listings: flattened columns plus key, vector and run stamp.
LISTING = T.StructType(
    _fields(T.StringType(), "_id SOURCE WEB_PROPERTY_CODE")
    + _fields(T.DoubleType(), "PRICE PRICE_ADMIN_INCLUDED AREA LATITUDE LONGITUDE")
    + _fields(T.StringType(), "ANTIQUITY")
    + _fields(T.IntegerType(), "CONSTRUCTION_YEAR")
    + _fields(T.DoubleType(), "BUILT_AREA PRIVATE_AREA GARAGE BATHROOMS ROOMS FLOOR")
    + _fields(T.StringType(), "PROPERTY_TYPE")
    + _fields(T.DoubleType(), "STRATUM BEDROOMS")
    + _fields(T.StringType(), "DESCRIPTION LINK")
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + _fields(T.TimestampType(), "scraped_at")
    + _fields(T.StringType(), "batch_id OPERATION_TYPE")
)


@dataclass(frozen=True)
class FeatureSpec:
    """Column names the price model is trained on."""

    target: str = "PRICE"
    numeric: tuple[str, ...] = (
        "AREA", "BUILT_AREA", "PRIVATE_AREA", "LATITUDE", "LONGITUDE", "FLOOR",
        "ROOMS", "BATHROOMS", "GARAGE", "STRATUM", "BEDROOMS",
    )
    categorical: tuple[str, ...] = ("ANTIQUITY", "PROPERTY_TYPE")

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categorical]

    @property
    def all(self) -> list[str]:
        return [self.target, *self.features]
