"""Column functions over IP addresses."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
# IPv4 networks that are not public.
NOT_PUBLIC = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4")

# The IPv6 network of public addresses, what in it is not public, and what in that is.
PUBLIC6 = ("2000::/3",)
NOT_PUBLIC6 = ("2001::/23", "2001:db8::/32", "2002::/16")
STILL_PUBLIC6 = ("2001:3::/32", "2001:20::/28", "2001:30::/28")


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a long; null if it is no IPv4 literal."""
    part = F.split(ip, r"\.")
    value = sum((F.get(part, F.lit(i)).cast("long") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("long"))
    return F.when(is_ipv4(ip), value)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6_groups(ip: Column) -> Column:
    """The eight groups of an IPv6 literal as an array of hexadecimal digits without leading zeros; null if it is none. An IPv4 tail is allowed."""
    tail = F.regexp_extract(ip, rf":({OCTET}(?:\.{OCTET}){{3}})$", 1)
    two = lambda n: F.concat(F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536)))
    plain = _let(tail, lambda t: F.when(t == "", ip).otherwise(F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(t)), _let(ipv4_number(t), two))))
    cut = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))
    digits = lambda g: F.coalesce(F.nullif(F.ltrim(g, F.lit("0")), F.lit("")), F.lit("0"))

    def filled(x: Column) -> Column:
        given = F.size(x["left"]) + F.size(x["right"])
        groups = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - given)), x["right"])
        whole = ((x["sides"] == 1) & (given == 8)) | ((x["sides"] == 2) & (given < 8))
        return F.when(whole, _let(groups, lambda g: F.when(F.forall(g, lambda d: d.rlike("^[0-9a-f]{1,4}$")), F.transform(g, digits))))

    sides = lambda s: _let(F.struct(F.size(s).alias("sides"), cut(F.get(s, F.lit(0))).alias("left"), cut(F.get(s, F.lit(1))).alias("right")), filled)
    return F.when(F.contains(ip, F.lit(":")), _let(F.split(F.lower(plain), "::"), sides))


def ipv6_halves(ip: Column) -> Column:
    """hi and lo, the two halves of an IPv6 literal as longs (of 64 bits, so with a sign); null if it is none."""
    half = lambda g, i: F.conv(F.array_join(F.transform(F.slice(g, i, 4), lambda d: F.lpad(d, 4, "0")), ""), 16, -10).cast("long")
    return _let(ipv6_groups(ip), lambda g: F.when(g.isNotNull(), F.struct(half(g, 1).alias("hi"), half(g, 5).alias("lo"))))


def ipv6_network(halves: Column, length: Column) -> Column:
    """hi and lo with all but the first `length` bits at zero."""
    cut = lambda x, bits: F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, x).otherwise(x.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), (64 - bits).cast("int"))))
    return F.struct(cut(halves["hi"], length).alias("hi"), cut(halves["lo"], length - 64).alias("lo"))


def canonical_ip(ip: Column) -> Column:
    """An IPv4 literal as it is, an IPv6 literal with its first longest run of zero groups as ::, null for other text."""

    def shortened(text: Column) -> Column:
        short = text
        for n in range(2, 9):  # the longest run is looked for first
            run = ":".join(["0"] * n)
            at = rf"^{run}$|^{run}:|:{run}:|:{run}$"
            short = F.when(text.rlike(at), F.regexp_replace(text, rf"^(.*?)(?:{at})(.*)$", "$1::$2")).otherwise(short)
        return short

    return F.when(is_ipv4(ip), ip).otherwise(_let(F.array_join(ipv6_groups(ip), ":"), shortened))


def public_ip(ip: Column) -> Column:
    """Whether an address lies in none of the networks that aren't public. Other text is not public."""
    n = ipv4_number(ip)
    nets = [ipaddress.ip_network(x) for x in NOT_PUBLIC]
    hit = reduce(or_, [n.between(int(x.network_address), int(x.broadcast_address)) for x in nets])

    def public6(top: Column) -> Column:
        """By the first 32 bits."""
        inside = lambda names: reduce(or_, [top.between(*(int(x) >> 96 for x in (y.network_address, y.broadcast_address))) for y in map(ipaddress.ip_network, names)])
        return inside(PUBLIC6) & (~inside(NOT_PUBLIC6) | inside(STILL_PUBLIC6))

    number = lambda g, i: F.conv(F.get(g, F.lit(i)), 16, 10).cast("long")
    top = _let(ipv6_groups(ip), lambda g: number(g, 0) * 65536 + number(g, 1))
    return F.coalesce(F.when(n.isNotNull(), ~hit).otherwise(_let(top, public6)), F.lit(False))


def client_key(domain: Column, ip: Column) -> Column:
    """lower(domain)|ip, or lower(domain) if there is no address."""
    name = F.lower(domain)
    return F.when(F.coalesce(ip, F.lit("")) == "", name).otherwise(F.concat(name, F.lit("|"), ip))
