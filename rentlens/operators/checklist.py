"""Checklist rows: defaults, names by code, dependent flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens.functions import text as T

# Codes, their names and defaults.
HOUSING_NAMES = {"APARTMENT": "아파트", "OFFICETEL": "오피스텔", "VILLA": "빌라", "HOUSE": "주택"}
DEFAULTS = {"housing_type_code": "APARTMENT", "contract_type": "NEW", "tenant_type": "PERSON", "landlord_type": "PERSON"}
FLAGS = ("fixed_date_confirmed", "officetel_residential_marked", "landlord_proxy_contract")


def checklist_columns(c: dict[str, Column]) -> dict[str, Column]:
    code = F.coalesce(c["housing_type_code"], F.lit(DEFAULTS["housing_type_code"]))
    names = F.create_map(*[F.lit(x) for p in HOUSING_NAMES.items() for x in p])
    out = {n: F.coalesce(c[n], F.lit(d)) for n, d in DEFAULTS.items()}
    out |= {n: F.coalesce(c[n], F.lit(False)) for n in FLAGS}
    out["officetel_residential_marked"] = out["officetel_residential_marked"] & (code == "OFFICETEL")
    out["housing_type_name"] = F.try_element_at(names, code)
    out["contract_address"] = F.when(c["contract_address"] == "", c["contract_address"]).otherwise(T.squeeze(c["contract_address"]))
    return out
