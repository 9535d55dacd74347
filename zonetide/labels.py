"""Class labels and their translation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Class labels in class order.
DEMAND_CLASSES = ("No Data", "Very Low", "Low", "Medium", "High", "Very High")
HOTSPOT_CLASSES = {
    -2: "Coldspot",
    -1: "Potential Coldspot",
    0: "Neutral",
    1: "Potential Hotspot",
    2: "Hotspot",
}
PRIORITY_CLASSES = ("Very Low", "Low", "Medium", "High", "Very High")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Turkish display texts.
TURKISH = {
    "No Data": "Veri Yok",
    "Very Low": "Çok Düşük",
    "Low": "Düşük",
    "Medium": "Orta",
    "High": "Yüksek",
    "Very High": "Çok Yüksek",
    "Coldspot": "Coldspot",
    "Potential Coldspot": "Potansiyel Coldspot",
    "Neutral": "Nötr",
    "Potential Hotspot": "Potansiyel Hotspot",
    "Hotspot": "Hotspot",
    "Rising": "Yükselen",
    "Falling": "Düşen",
    "Stable": "Stabil",
    "High Demand": "Yüksek Talep",
    "Low Demand": "Düşük Talep",
    "Monday": "Pazartesi",
    "Tuesday": "Salı",
    "Wednesday": "Çarşamba",
    "Thursday": "Perşembe",
    "Friday": "Cuma",
    "Saturday": "Cumartesi",
    "Sunday": "Pazar",
}

LABEL_COLUMNS = ("demand_class", "hotspot_class", "priority_class", "trend_direction",
                 "anomaly_type", "peak_weekday_name")


def lookup(key: Column, values: dict[int, str]) -> Column:
    """Map an integer key to its label; null when the key has none."""
    chain = F.lit(None).cast("string")
    for number, text in values.items():
        chain = F.when(key == number, text).otherwise(chain)
    return chain


def in_turkish(df: DataFrame) -> DataFrame:
    """Replace the English labels of a result by the Turkish display texts."""
    present = [c for c in LABEL_COLUMNS if c in df.columns]
    if present:
        df = df.replace(TURKISH, subset=present)
    if "items" in df.columns:
        texts = F.create_map(*[F.lit(t) for pair in TURKISH.items() for t in pair])
        df = df.withColumn("items", F.transform("items", lambda item: item.withField(
            "anomaly_type", F.element_at(texts, item["anomaly_type"]))))
    return df
