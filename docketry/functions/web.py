"""URL pre-flight checks, address classes, media signatures and digests."""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reason codes.
OK, UNPARSEABLE_URL, SCHEME, UNPARSEABLE, LOOPBACK, LINK_LOCAL, PRIVATE, CGNAT, UNIQUE_LOCAL, NON_UNICAST = (
    "OK", "UNPARSEABLE_URL", "SCHEME_NOT_ALLOWED", "UNPARSEABLE_ADDRESS", "LOOPBACK", "LINK_LOCAL", "PRIVATE_RANGE", "CGNAT", "UNIQUE_LOCAL", "NON_UNICAST",
)
# The networks of each code; the first that holds an address decides, and any other odd one is refused.
NETWORKS = [
    (LOOPBACK, "127.0.0.0/8"), (LOOPBACK, "::1/128"), (LINK_LOCAL, "169.254.0.0/16"), (LINK_LOCAL, "fe80::/10"),
    (PRIVATE, "10.0.0.0/8"), (PRIVATE, "172.16.0.0/12"), (PRIVATE, "192.168.0.0/16"), (CGNAT, "100.64.0.0/10"),
    (UNIQUE_LOCAL, "fc00::/7"), (NON_UNICAST, "0.0.0.0/8"), (NON_UNICAST, "192.0.0.0/24"), (NON_UNICAST, "192.0.2.0/24"),
    (NON_UNICAST, "192.88.99.0/24"), (NON_UNICAST, "198.18.0.0/15"), (NON_UNICAST, "198.51.100.0/24"), (NON_UNICAST, "203.0.113.0/24"),
    (NON_UNICAST, "224.0.0.0/4"), (NON_UNICAST, "240.0.0.0/4"), (NON_UNICAST, "::/128"), (NON_UNICAST, "ff00::/8"),
    (NON_UNICAST, "64:ff9b::/96"), (NON_UNICAST, "2001::/32"), (NON_UNICAST, "2002::/16"), (NON_UNICAST, "2001:db8::/32"),
]
_NETWORKS = [(code, ipaddress.ip_network(x)) for code, x in NETWORKS]


def address_code(literal: str) -> str:
    """The code of an IP literal: only unicast addresses are OK; a mapped IPv4 address counts as itself."""
    try:
        address = ipaddress.ip_address(literal)
    except ValueError:
        return UNPARSEABLE
    address = getattr(address, "ipv4_mapped", None) or address
    return next((code for code, net in _NETWORKS if address.version == net.version and address in net), OK)


@F.pandas_udf(T.StringType())
def classify_address(literals: pd.Series) -> pd.Series:
    return literals.map(lambda x: None if x is None else address_code(x))


def inspect_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed and code. Literals alone go through Python, as a frame of their own."""
    u = F.col(url)
    scheme = F.lower(F.regexp_extract(u, r"\A\s*([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(u, r"\A\s*[A-Za-z][A-Za-z0-9+.\-]*:/*(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    code = (
        F.when(u.isNull() | (scheme == ""), UNPARSEABLE_URL).when(~scheme.isin("http", "https"), SCHEME).when(host == "", UNPARSEABLE_URL)
        .when(F.regexp_like(host, F.lit(r"^(.*\.)?localhost\.?$")), LOOPBACK)
    )
    rows = urls.withColumns({"__host": F.regexp_replace(host, r"^\[|\]$", ""), "code": code})
    literal = F.col("code").isNull() & F.regexp_like("__host", F.lit(r"^[0-9.]+$|:"))
    out = rows.where(~literal).withColumn("code", F.coalesce("code", F.lit(OK))).union(rows.where(literal).withColumn("code", classify_address("__host")))
    return out.withColumn("allowed", F.col("code") == OK).drop("__host")


def media_type(content: Column) -> Column:
    """jpeg, png or webp by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(
        F.regexp_like(head, F.lit("^52494646.{8}57454250")), "image/webp")


def content_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def url_safe_digest(token: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.unhex(F.sha2(token, 256))), "+/", "-_"), F.lit("="))


@F.pandas_udf(T.StringType())
def first_resolvable(base: pd.Series, candidates: pd.Series) -> pd.Series:
    """The first candidate that resolves to an http or https address."""

    def one(b: str, urls) -> str | None:
        for u in urls if urls is not None else []:
            if u:
                full = urljoin(b or "", u)
                parts = urlsplit(full)
                if parts.scheme in ("http", "https") and parts.netloc:
                    return full
        return None

    return pd.Series([one(b, c) for b, c in zip(base, candidates)])
