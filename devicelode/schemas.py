"""Column layouts of the tables the library works on."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


CATALOGUE = _strings("brand_name", "device_name", "device_url", "device_image")
SPECS_NARROW = _strings("device_url", "name", "pictures", "specifications")
SPECS_WIDE = _strings(
    "device_url", "name", "pictures", "specifications", "technology", "display_type", "dimensions", "os",
    "colors", "battery_type", "main_camera", "selfie_camera", "sensors", "price_info")

BRAND = "struct<name: string, url: string, device_count: bigint>"
BRAND_SNAPSHOT = f"timestamp string, brands array<{BRAND}>, brand_count bigint"
ACCESS_KEY = "struct<name: string, email: string, tier: string, created_at: string, last_used: string, usage_count: bigint>"
LEDGER_ENTRY = "struct<last_updated: string, brand: string>"
