"""IP addresses and indicators as Column expressions over built-in functions."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from brackwater.functions.scalars import let

OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = f"^{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}$"
# Networks that count as private, pinned here so that no interpreter version decides.
PRIVATE_V4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32")
PRIVATE_V6 = ("::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "fc00::/7", "fe80::/10")
_V6 = [ipaddress.ip_network(n) for n in PRIVATE_V6]
# Words that mark a log as facing outside.
EXTERNAL_WORDS = ("web", "gateway", "mail", "external", "vpn")


def private_ranges() -> list[tuple[int, int]]:
    nets = [ipaddress.ip_network(n) for n in PRIVATE_V4]
    return [(int(n.network_address), int(n.broadcast_address)) for n in nets]


_HEX = "[0-9a-fA-F]{1,4}"


def _ipv6_text(ip: Column) -> Column:
    """Without a scope, and with an IPv4 tail as two groups."""
    plain = F.regexp_replace(ip, "%[^%]+$", "")
    tail = F.substring_index(plain, ":", -1)
    number = ipv4_number(tail)
    groups = F.concat(F.hex(F.shiftright(number, 16)), F.lit(":"), F.hex(number.bitwiseAND(0xFFFF)))
    return F.when(is_ipv4(tail), F.concat(F.left(plain, F.length(plain) - F.length(tail)), groups)).otherwise(plain)


def is_ipv6(ip: Column) -> Column:
    """Whether ip is an IPv6 address: eight groups, or fewer around one double colon."""
    s = _ipv6_text(ip)
    short = s.rlike(f"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$") & (F.size(F.regexp_extract_all(s, F.lit(f"({_HEX})"), F.lit(1))) <= 7)
    # `when`, not `&`: shared steps of an operand of `&` are worked out for every row, also where the other one is false
    return F.when(ip.contains(":"), s.rlike(f"^({_HEX}:){{7}}{_HEX}$") | short).otherwise(False)


def ipv6_groups(ip: Column) -> Column:
    """The eight groups as numbers; null for anything else."""
    s = _ipv6_text(ip)
    side = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = side(F.substring_index(s, "::", 1)), F.when(s.contains("::"), side(F.substring_index(s, "::", -1))).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(left) - F.size(right))
    return F.when(is_ipv6(ip), F.transform(F.concat(left, zeros, right), lambda g: F.conv(g, 16, 10).cast("int")))


def is_private_ipv6(ip: Column) -> Column:
    def any_net(x: Column) -> Column:
        inside = F.lit(False)
        for net in _V6:
            number, same = int(net.network_address), F.lit(True)
            for i in range(-(-net.prefixlen // 16)):
                drop = max(0, 16 * (i + 1) - net.prefixlen)
                same = same & (F.shiftright(x["groups"][i], drop) == ((number >> (112 - 16 * i)) & 0xFFFF) >> drop)
            inside = inside | same
        return F.coalesce(inside, F.lit(False))

    return let({"groups": ipv6_groups(ip)}, any_net)


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_valid_ip(ip: Column, v6: bool = True) -> Column:
    """Whether ip is an IPv4 address without leading zeros, or (with `v6`) an IPv6 address. Null is not valid."""
    return is_ipv4(ip) | is_ipv6(ip) if v6 else is_ipv4(ip)


def ipv4_number(ip: Column) -> Column:
    """IPv4 address as a number; null for anything else."""

    def value(x: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(4):
            out = out * 256 + F.get(x["parts"], F.lit(i)).try_cast("long")
        return out

    return F.when(is_ipv4(ip), let({"parts": F.split(ip, "\\.")}, value))


def is_private_ip(ip: Column, v6: bool = True) -> Column:

    def any_range(x: Column) -> Column:
        out = F.lit(False)
        for lo, hi in private_ranges():
            out = out | x["number"].between(lo, hi)
        return F.coalesce(out, F.lit(False))

    inside = let({"number": ipv4_number(ip)}, any_range)
    return F.when(ip.contains(":"), is_private_ipv6(ip)).otherwise(inside) if v6 else inside


def is_external_facing(source: Column, line: Column, log_type: Column) -> Column:
    text = F.lower(F.concat_ws(" ", source, line))
    return F.coalesce(text.rlike("|".join(EXTERNAL_WORDS)), F.lit(False)) | (F.coalesce(log_type, F.lit("")) == "dns")


def generalize_ip(ip: Column) -> Column:
    """a.b.c.d becomes a.b.c.0; anything that has not four dotted parts stays."""
    parts = F.split(ip, "\\.")
    return F.when(F.size(parts) == 4, F.concat(F.array_join(F.slice(parts, 1, 3), "."), F.lit(".0"))).otherwise(ip)


# Fixed value: the pattern of a domain name.
FQDN = r"^(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}$"


def indicator_type(s: Column) -> Column:
    """ipv4, hash, url, domain or unknown, the first that fits."""
    s = F.trim(s)
    slash, dot = F.instr(s, "/"), F.instr(s, ".")
    return (
        F.when(is_ipv4(s), "ipv4")
        .when(s.rlike("^([a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64})$"), "hash")
        .when(s.rlike("(?i)^https?://") | ((slash > 0) & (dot > 0) & (dot < slash)), "url")
        .when(s.rlike(FQDN), "domain")
        .otherwise("unknown")
    )
