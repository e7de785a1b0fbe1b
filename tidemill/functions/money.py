"""Column expressions on prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def discounted(price: Column, discount: Column) -> Column:
    return price * (F.lit(1.0) - discount)


def charged(price: Column, discount: Column, tax: Column) -> Column:
    return discounted(price, discount) * (F.lit(1.0) + tax)
