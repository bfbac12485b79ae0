"""Addresses and URLs as column expressions."""

from __future__ import annotations

from ipaddress import ip_network

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rate_key_hash, trimmed

#: Networks that must not be reached.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.31.196.0/24", "192.52.193.0/24",
    "192.88.99.0/24", "192.168.0.0/16", "192.175.48.0/24", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = (
    "::/96", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "100:0:0:1::/64", "2001::/23", "2001:db8::/32",
    "2002::/16", "2620:4f:8000::/48", "3fff::/20", "5f00::/16", "fc00::/7", "fe80::/10", "fec0::/10", "ff00::/8",
)
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def ipv4_number(c: Column) -> Column:
    """A dotted quad as a number; null for anything else."""
    parts = F.split(c, "\\.")
    return F.when(c.rlike(IPV4), F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))


def _range(net: str) -> tuple[int, int]:
    n = ip_network(net)
    return int(n.network_address), int(n.broadcast_address)


def blocked_ipv4(c: Column) -> Column:
    """In a blocked network, or no address at all."""
    number = ipv4_number(c)
    hits = [number.between(*_range(net)) for net in BLOCKED_V4]
    out = hits[0]
    for h in hits[1:]:
        out = out | h
    return F.coalesce(out, F.lit(True))


def blocked_ip(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Adds out: blocked, for both families.  Version 4 stays in expressions; only rows with a colon go through Arrow."""
    import pandas as pd

    v6 = BLOCKED_V6

    def check(s):
        from ipaddress import IPv6Address, ip_address, ip_network

        nets = [ip_network(n) for n in v6]

        def one(x):
            try:
                a = ip_address(x)
            except ValueError:
                return True
            if isinstance(a, IPv6Address) and a.scope_id:
                return True
            return any(a in n for n in nets)

        return s.map(one).astype(bool)

    check.__annotations__ = {"s": pd.Series, "return": pd.Series}
    slow = F.pandas_udf(check, "boolean")

    mapped = F.regexp_extract(ip, r"(?i)^::ffff:([0-9.]+)\z", 1)
    return df.withColumn(out, F.when(mapped != "", blocked_ipv4(mapped)).when(F.contains(ip, F.lit(":")), slow(F.col(ip))).otherwise(blocked_ipv4(F.col(ip))))


_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]*))?(?:[/?#]|\z)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    """Lower case, without a final dot."""
    return F.regexp_replace(F.lower(trimmed(F.regexp_extract(url, _URL, 2))), r"\.\z", "")


def effective_port(url: Column) -> Column:
    port = F.regexp_extract(url, _URL, 3)
    return F.when(url.isNull(), F.lit(None)).when(port != "", port).when(scheme(url) == "http", "80").when(scheme(url) == "https", "443").otherwise("")


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & (effective_port(a) == effective_port(b))


def url_policy(url: Column, hosts: tuple[str, ...] = (), ports: tuple[str, ...] = (), schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """The first rule a URL breaks: scheme, missing_host, host or port; null if none.  No hosts or ports: any."""
    return (
        F.when(~scheme(url).isin(*schemes), "scheme").when(host(url) == "", "missing_host").when(~host(url).isin(*hosts) if hosts else F.lit(False), "host").when(~effective_port(url).isin(*ports) if ports else F.lit(False), "port")
    )


def in_networks(number: Column, nets: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for net in nets:
        out = out | number.between(*_range(net))
    return out


def client_ip(remote: Column, forwarded: Column, real: Column, trusted: tuple[str, ...]) -> Column:
    """The remote address, unless it is a trusted proxy: then the right-most forwarded address that isn't, or else the real-ip header's."""
    fits = lambda c: c.rlike(IPV4) & ~in_networks(ipv4_number(c), trusted)
    hops = F.filter(F.transform(F.reverse(F.split(forwarded, ",")), trimmed), fits)
    through = F.when(F.coalesce(forwarded, F.lit("")) != "", F.try_element_at(hops, F.lit(1))).when(fits(trimmed(real)), trimmed(real))
    return F.when(~F.coalesce(in_networks(ipv4_number(remote), trusted), F.lit(False)), remote).otherwise(F.coalesce(through, remote))


def rate_identity(api_key: Column, ip: Column) -> Column:
    key = trimmed(F.coalesce(api_key, F.lit("")))
    return F.when(key != "", F.concat(F.lit("key:"), rate_key_hash(key))).otherwise(F.concat(F.lit("ip:"), F.coalesce(F.nullif(ip, F.lit("")), F.lit("unknown"))))


def redirect_verdicts(hops: DataFrame, chain: str, order: str, url: str, most: int, **policy) -> DataFrame:
    """Adds to each hop of a chain: verdict (ok, too_many or the rule its URL breaks) and strip_headers (its origin differs from the hop before)."""
    from pyspark.sql import Window

    w = Window.partitionBy(chain).orderBy(order)
    before = F.lag(url).over(w)
    n = F.row_number().over(w)
    verdict = F.when(n - 1 > most, "too_many").otherwise(F.coalesce(url_policy(F.col(url), **policy), F.lit("ok")))
    return hops.withColumns({"verdict": verdict, "strip_headers": F.coalesce(~same_origin(F.col(url), before), F.lit(False))})
