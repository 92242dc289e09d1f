"""Names, labels and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the terminal report.
NO_NAME = "–"
LUNCH_CHECK_BRAND = "Lunch Check"
LUNCH_CHECK_GROUP = "Lunch-Check"
DEFAULT_BRAND_GROUP = "Default"
LABEL_SEPARATOR = " · "
# What counts as white space around a name.
WHITE_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(trimmed(text), F.lit(""))


def outlet_group(terminal_name: Column) -> Column:
    """Terminal name without its trailing number; an all-digit name stays as it is."""
    name = trimmed(terminal_name)
    return F.coalesce(
        blank_to_null(F.regexp_replace(name, r"[0-9]+\z", "")),
        blank_to_null(name),
        F.lit(NO_NAME),
    )


def brand_group(brand: Column, default: str = DEFAULT_BRAND_GROUP) -> Column:
    return F.when(brand == LUNCH_CHECK_BRAND, LUNCH_CHECK_GROUP).otherwise(default)


def digits_only(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def space_label(space_id: Column, name: Column) -> Column:
    """``id · name``; a blank part is left out together with the separator."""
    return F.concat_ws(
        LABEL_SEPARATOR, blank_to_null(space_id.cast("string")), blank_to_null(name)
    )


def belongs_to_space(space_id: Column, space_tag: Column, wanted: Column) -> Column:
    """Exact match on the space id, or on the id at the head of an ``id · name`` tag."""
    own = F.coalesce(
        blank_to_null(space_id.cast("string")),
        blank_to_null(F.split_part(space_tag, F.lit(LABEL_SEPARATOR), F.lit(1))),
    )
    return F.coalesce(own == blank_to_null(wanted.cast("string")), F.lit(False))


def status_text(payload: Column) -> Column:
    """Upper-case status of a JSON answer that holds it flat or nested one level."""
    return F.upper(
        F.coalesce(
            F.get_json_object(payload, "$.status.status"),
            F.get_json_object(payload, "$.status"),
            F.lit(""),
        )
    )
