"""IPv4 tests as column expressions (no UDF)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# one decimal octet 0..255 without leading zeros, ASCII digits only
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def octet(ip: Column, i: int) -> Column:
    return F.regexp_extract(ip, IPV4, i).try_cast("int")


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_internal(ip: Column) -> Column:
    """RFC 1918 only: 10/8, 172.16/12, 192.168/16.  Anything that is not a
    strict dotted quad (IPv6, names, '10.0.0.300') is external."""
    o1, o2 = octet(ip, 1), octet(ip, 2)
    return F.coalesce(
        is_ipv4(ip) & ((o1 == 10) | ((o1 == 172) & o2.between(16, 31)) | ((o1 == 192) & (o2 == 168))),
        F.lit(False))
