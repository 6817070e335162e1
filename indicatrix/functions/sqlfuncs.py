"""The operators as SQL functions, for users who work in SQL.

Catalyst inlines these bodies, so a query with them has the same plan as one
written with the DataFrame operators.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from indicatrix.functions import extract as X
from indicatrix.functions import validate as V
from indicatrix.functions.normalize import defang, refang

SCALAR_FUNCTIONS = {
    "refang": ("STRING", refang("s")),
    "defang": ("STRING", defang("s")),
    "url_host": ("STRING", X.url_host("s")),
    "hash_type": ("STRING", V.hash_type("s")),
    "is_ipv4": ("BOOLEAN", V.is_ipv4("s")),
    "is_ipv6": ("BOOLEAN", V.is_ipv6("s")),
    "is_indicator_domain": ("BOOLEAN", V.is_indicator_domain("s")),
    "is_domain_name": ("BOOLEAN", V.is_domain_name("s")),
    "is_cve": ("BOOLEAN", V.is_cve("s")),
    "is_email": ("BOOLEAN", V.is_email("s")),
    "is_url": ("BOOLEAN", V.is_url("s")),
}
# name -> matches in s, check on value, result value
TABLE_FUNCTIONS = {
    "ipv4_in": (X.ipv4_matches("s"), V.is_ipv4("value"), "value"),
    "ipv6_in": (X.ipv6_matches("s"), "true", "value"),
    "domain_in": (X.domain_matches("s"), V.is_indicator_domain("value"), "value"),
    "url_in": (X.url_matches("s"), "true", "value"),
    "email_in": (X.email_matches("s"), "true", "value"),
    "cve_in": (X.cve_matches("s"), "true", "value"),
    "mitre_in": (X.mitre_matches("s"), "true", "value"),
    "hash_in": (X.hash_matches("s"), "true", "lower(value)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the temporary functions; returns their names.

    ``refang(s)`` and the other scalar functions take a string; ``ipv4_in(s)``
    and the other table functions give ``(pos, value)`` and go after LATERAL.
    """
    for name, (type_, body) in SCALAR_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {type_} RETURN {body}")
    for name, (matches, valid, value) in TABLE_FUNCTIONS.items():
        # No WHERE: with one, LATERAL becomes a join of the texts with all different texts.
        found = f"array_compact(transform({matches}, (value, pos) -> IF({valid}, named_struct('pos', pos, 'value', {value}), NULL)))"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS TABLE(pos INT, value STRING) "
            f"RETURN SELECT pos, value FROM inline({found})"
        )
    return [*SCALAR_FUNCTIONS, *TABLE_FUNCTIONS]
