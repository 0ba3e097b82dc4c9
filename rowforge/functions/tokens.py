"""Claims of three-part tokens. Signatures are not checked here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The claims of a token and their types.
CLAIMS = {
    "user_id": "string",
    "username": "string",
    "exp": "bigint",
    "iat": "bigint",
    "aud": "string",
    "iss": "string",
}


def token_payload(token: Column) -> Column:
    """JSON text of the middle part, null when the token is malformed."""
    parts = F.split(token, r"\.", -1)
    body = F.regexp_replace(F.translate(F.get(parts, F.lit(1)), "-_", "+/"), r"\s", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    return F.when(
        F.size(parts) == 3,
        F.try_to_binary(padded, F.lit("base64")).try_cast("string"),
    )


def decode_tokens(df: DataFrame, token: str, claims: str = "claims") -> DataFrame:
    """Add a struct of the claims, null when the token is malformed.

    The payload is taken apart once, in a column of its own, and each claim is read
    from the parsed form.
    """
    parsed = df.withColumn("__payload", token_payload(F.col(token))).withColumn(
        "__json", F.try_parse_json("__payload")
    )
    is_object = F.ltrim("__payload").startswith("{") & F.col("__json").isNotNull()
    values = [
        F.try_variant_get("__json", f"$.{name}", kind).alias(name) for name, kind in CLAIMS.items()
    ]
    return parsed.withColumn(claims, F.when(is_object, F.struct(*values))).drop(
        "__payload", "__json"
    )


def token_expired(exp: Column, now: Column) -> Column:
    """Expired, or without a usable expiry."""
    return F.coalesce((exp == 0) | (exp < now), F.lit(True))


def claims_issue(claims: Column, audience: str, issuer: str, now: Column) -> Column:
    """The first reason to refuse a token, or null."""
    return (
        F.when(claims.isNull(), "malformed")
        .when(token_expired(claims["exp"], now), "expired")
        .when(~claims["aud"].eqNullSafe(F.lit(audience)), "wrong_audience")
        .when(~claims["iss"].eqNullSafe(F.lit(issuer)), "wrong_issuer")
        .when(claims["user_id"].isNull(), "missing_user_id")
    )
