"""Push deliveries: which provider, is it genuine, what was pushed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64  # bytes in a SHA-256 block


def lower_keys(headers: Column) -> Column:
    return F.transform_keys(headers, lambda k, _v: F.lower(k))


def provider(headers: Column) -> Column:
    h = lower_keys(headers)
    has = lambda k: F.map_contains_key(h, k)
    return (
        F.when(has("x-github-event") | has("x-hub-signature-256"), "github")
        .when(has("x-gitlab-event") | has("x-gitlab-token"), "gitlab")
        .when(F.coalesce(F.lower(F.element_at(h, "x-event-key")).contains("repo"), F.lit(False)), "bitbucket")
    )


def pads(key: Column) -> Column:
    """struct(inner, outer): what a text key contributes to an HMAC-SHA256, the same for every message."""
    raw = F.encode(key, "utf-8")
    short = F.when(F.octet_length(raw) > BLOCK, F.sha2(raw, 256)).otherwise(F.lower(F.hex(raw)))
    padded = F.rpad(short, BLOCK * 2, "0")
    byte = lambda i: F.conv(F.substr(padded, i * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def xored(with_: int) -> Column:
        digits = F.transform(
            F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(with_))), 2, "0")
        )
        return F.unhex(F.array_join(digits, ""))

    return F.struct(xored(0x36).alias("inner"), xored(0x5C).alias("outer"))


def hmac_with(pads_: Column, message: Column) -> Column:
    """HMAC of a text message, as lower-case hex, from the pads of its key."""
    inner = F.sha2(F.concat(pads_["inner"], F.encode(message, "utf-8")), 256)
    return F.sha2(F.concat(pads_["outer"], F.unhex(inner)), 256)


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC of a text message under a text key. Where keys repeat, join `padded_secrets` instead."""
    return hmac_with(pads(key), message)


def padded_secrets(hooks: DataFrame) -> DataFrame:
    """(secret, pads): the pads of every distinct secret, made once however many deliveries it signs."""
    return hooks.select("secret").where("secret <> ''").distinct().withColumn("pads", pads(F.col("secret")))


def genuine(provider_: Column, headers: Column, body: Column, secret: Column, query_token: Column, pads_: Column) -> Column:
    """Whether a delivery proves knowledge of the secret (and its pads) in its provider's way."""
    h = lower_keys(headers)
    head = lambda k: F.coalesce(F.element_at(h, k), F.lit(""))
    proof = (
        F.when(provider_ == "github", head("x-hub-signature-256") == F.concat(F.lit("sha256="), hmac_with(pads_, body)))
        .when(provider_ == "gitlab", head("x-gitlab-token") == secret)
        .when(provider_ == "bitbucket", F.coalesce(query_token, F.lit("")) == secret)
        .otherwise(False)
    )
    return F.coalesce(secret != "", F.lit(False)) & F.coalesce(proof, F.lit(False))


def push(provider_: Column, headers: Column, body: Column) -> Column:
    """struct(full_name, ref) of a push; null for other events and broken bodies."""
    h = lower_keys(headers)
    v = F.try_parse_json(body)
    get = lambda path: F.try_variant_get(v, path, "string")
    event = lambda k: F.coalesce(F.element_at(h, k), F.lit(""))
    named = lambda name, ref: F.when(F.coalesce(name != "", F.lit(False)), F.struct(name.alias("full_name"), ref.alias("ref")))
    branch = F.nullif(get("$.push.changes[0].new.name"), F.lit(""))
    return (
        F.when((provider_ == "github") & (event("x-github-event") == "push"), named(get("$.repository.full_name"), get("$.ref")))
        .when((provider_ == "gitlab") & F.lower(event("x-gitlab-event")).contains("push"), named(get("$.project.path_with_namespace"), get("$.ref")))
        .when(
            (provider_ == "bitbucket") & (F.lower(event("x-event-key")) == "repo:push"),
            named(get("$.repository.full_name"), F.concat(F.lit("refs/heads/"), branch)),
        )
    )
