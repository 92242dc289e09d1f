"""Label lookup on charge attempts and the brand fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label descriptors that mark the masked card number and the authorisation code.
MASKED_CARD_LABEL = "1456765125779"
AUTH_CODE_LABEL = "1579287795628"


def label_text(labels: Column, descriptor: str) -> Column:
    """Short text of the first label with this descriptor; NULL when there is none."""
    matching = F.filter(labels, lambda label: label["descriptor"] == descriptor)
    return F.try_element_at(matching, F.lit(1))["shortTextContent"]


def brand_name(connector_names: Column, configuration_name: Column) -> Column:
    """English connector name, else the configured name, else ``UNKNOWN``."""
    return F.coalesce(connector_names["en-US"], configuration_name, F.lit("UNKNOWN"))
