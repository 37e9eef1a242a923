"""Column expressions over digests, numbers and states."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an unset compliance flag is written as.
NO_TEXT = ("no", "false", "0", "off", "n", "f", "blank")
# A verifier's answer and the status that it stands for.
EMAIL_STATUS = {"valid": "verified", "accept_all": "accept_all", "invalid": "invalid", "unknown": "unknown", "webmail": "unknown", "disposable": "unknown"}
# Confidence of an answer by the rung of the lookup ladder that found it.
RUNG_CONFIDENCE = {"id": 0.9, "linkedin": 0.9, "email": 0.9, "name_domain": 0.6, "name_org": 0.5}


def canonical(**parts: Column) -> Column:
    """Canonical JSON of named text values: names sorted, nulls left out."""
    ordered = [F.concat(F.lit(f'"{k}":'), F.lit('"'), F.regexp_replace(parts[k].cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*ordered)), ","), F.lit("}"))


def content_sha(**parts: Column) -> Column:
    return F.sha2(canonical(**parts), 256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC by its definition: two padded digests."""
    block = key.ljust(64, b"\0")
    outer, inner = bytes(b ^ 0x5C for b in block), bytes(b ^ 0x36 for b in block)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def is_flag_set(text: Column) -> Column:
    """Fail-closed: everything that does not say no is set."""
    t = F.lower(F.trim(text))
    return F.coalesce((t != "") & ~t.isin(*NO_TEXT), F.lit(False))


def milli(x: Column) -> Column:
    return F.bround(x.cast("decimal(38,18)") * 1000, 0).cast("int")


def quantize(x: Column, places: int = 3) -> Column:
    return F.bround(x, places)


def unit_interval(seed: int, ident: Column, purpose: str) -> Column:
    """The first eight bytes of sha256(seed:id:purpose) as a share of 2^64."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), ident.cast("string"), F.lit(purpose)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def exact_credits(text: Column) -> Column:
    """Credits in thousandths, or null: no fractions finer than that, nothing negative."""
    fits = text.rlike(r"^[0-9]{1,18}(\.[0-9]{1,3}0*)?$")
    return F.when(fits, (text.cast("decimal(38,6)") * 1000).cast("long"))


def provider_bill(emails: Column, finds: Column, verifications: Column, price: str = "0.500") -> Column:
    return (F.ceil(emails / 10) + finds).cast("decimal(18,3)") + verifications.cast("decimal(18,0)") * F.lit(price).cast("decimal(6,3)")


def email_status(stated: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in EMAIL_STATUS.items():
        out = F.when(stated == k, v).otherwise(out)
    return out


def rung_confidence(rung: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in RUNG_CONFIDENCE.items():
        out = F.when(rung == k, v).otherwise(out)
    return out


def retry_after(text: Column) -> Column:
    """Seconds of a header of digits only, positive."""
    seconds = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))
    return F.when(seconds > 0, seconds)


def still_employed(jobs: Column) -> Column:
    """False only where every job there is stated to be over, null where some is not stated."""
    over = F.size(jobs) > 0
    return F.when(F.exists(jobs, lambda j: F.coalesce(j, F.lit(False))), True).when(over & F.forall(jobs, lambda j: F.coalesce(~j, F.lit(False))), False)


def error_class(provider: Column, status: Column) -> Column:
    """What an HTTP status means; one provider swaps its codes."""
    swapped = F.when(status == 403, "rate_limited").when(status == 429, "quota").when(status == 451, "compliance")
    usual = F.when(status.isin(401, 403), "unauthorized").when(status == 429, "rate_limited").when((status >= 500) | (status == 408), "transient")
    return F.when(status < 400, "ok").when(provider == "email", F.coalesce(swapped, usual, F.lit("permanent"))).otherwise(F.coalesce(usual, F.lit("permanent")))


def resolved_mode(per_source: Column, overall: Column, live_available: Column, has_credentials: Column) -> Column:
    stated = F.coalesce(per_source, overall)
    return F.when(stated.isNotNull(), stated).when(~live_available, "synthetic").when(~has_credentials, "synthetic").otherwise("live")


def database_now(seconds: float = 0) -> Column:
    """The session's clock, ``seconds`` on: one time for all rows of a query."""
    return F.current_timestamp() + F.make_dt_interval(secs=F.lit(seconds).cast("decimal(18,6)"))
