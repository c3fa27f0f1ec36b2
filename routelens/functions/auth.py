"""Authentication-method detection."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from routelens.schemas import AUTH_METHODS, DISCOVERY_SOURCES


def auth_from_header(header: Column) -> Column:
    """Kind of credentials named in a header or log fragment; first matching word wins."""
    text = F.lower(header)
    return (
        F.when(text.contains("bearer "), "bearer")
        .when(text.contains("apikey") | text.contains("x-api-key"), "api_key")
        .when(text.contains("basic "), "basic")
        .when(~text.contains("authorization"), "none")
        .otherwise("unknown")
    )


def auth_from_authorizer(authorizer: Column) -> Column:
    """API-gateway authorizer type -> authentication method (absent type means ``none``)."""
    kind = F.lower(F.coalesce(authorizer, F.lit("")))
    return (
        F.when(kind.contains("cognito") | kind.contains("jwt") | kind.contains("token"), "bearer")
        .when(kind.contains("iam"), "api_key")
        .when(kind.isin("", "none"), "none")
        .otherwise("unknown")
    )


def _bits(value: Column, domain: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for i, name in enumerate(domain):
        out = F.when(value == name, 1 << i).otherwise(out)
    return out


def _names(bits: Column, domain: tuple[str, ...]) -> Column:
    marks = [F.when(bits.bitwiseAND(1 << i) != 0, name) for i, name in enumerate(domain)]
    return F.sort_array(F.array_compact(F.array(*marks)))


def auth_bits(auth: Column) -> Column:
    """One bit per value of the closed set: a distinct-set that aggregates as an integer OR."""
    return _bits(auth, AUTH_METHODS)


def auth_names(bits: Column) -> Column:
    return _names(bits, AUTH_METHODS)


def source_bits(source: Column) -> Column:
    return _bits(source, DISCOVERY_SOURCES)


def source_names(bits: Column) -> Column:
    return _names(bits, DISCOVERY_SOURCES)
