"""Whether an address is private: the general form, for IPv6 and the addresses inside it."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges that are refused beside those that carry an IPv4 address.
_REFUSED_V6 = [ipaddress.ip_network(n) for n in ("::/96", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8", "100::/64", "2001:db8::/32", "64:ff9b:1::/48")]
_REFUSED_V4 = [
    ipaddress.ip_network(n)
    for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/16", "192.168.0.0/16", "198.18.0.0/15", "198.51.0.0/16", "203.0.0.0/16", "224.0.0.0/3")
]


def is_private(text: str | None) -> bool:
    """True for what must not be fetched from, and for what is no address at all."""
    try:
        ip = ipaddress.ip_address((text or "").strip().removeprefix("[").removesuffix("]").partition("%")[0])
    except ValueError:
        return True
    if ip.version == 4:
        return any(ip in n for n in _REFUSED_V4)
    inside = []
    if ip.ipv4_mapped:
        inside = [ip.ipv4_mapped]
    elif ip in ipaddress.ip_network("64:ff9b::/96"):
        inside = [ipaddress.IPv4Address(int(ip) & 0xFFFFFFFF)]
    elif ip.sixtofour:
        inside = [ip.sixtofour]
    elif ip.teredo:
        inside = list(ip.teredo)
    if inside:
        return any(is_private(str(x)) for x in inside)
    return any(ip in n for n in _REFUSED_V6)


def _all_private(ips: pd.Series) -> pd.Series:
    return ips.map(is_private)


def private_address(ip: Column) -> Column:
    return F.pandas_udf(_all_private, "boolean")(ip)
