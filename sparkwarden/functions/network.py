"""IP addresses: allowed networks and the client behind trusted proxies."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkwarden.functions.text import let


def ipv4_number(s: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    parts = F.split(s, r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.try_cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    return F.when(s.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def _groups(part: Column) -> Column:
    return F.filter(F.split(part, ":", -1), lambda g: (g != "") | (part != ""))


def ipv6_digits(s: Column) -> Column:
    """An IPv6 address as its 32 hexadecimal digits, which order as addresses do; null for anything else. A zone is left out."""

    def plain(low: Column) -> Column:
        """With an IPv4 tail as two groups."""
        tail = F.regexp_extract(low, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        digits = F.lower(F.lpad(F.hex(ipv4_number(tail)), 8, "0"))
        return F.when(~F.contains(low, F.lit(".")), low).otherwise(F.concat(F.substring(low, F.lit(1), F.length(low) - F.length(tail)), F.left(digits, F.lit(4)), F.lit(":"), F.right(digits, F.lit(4))))

    def every(halves: Column) -> Column:
        """All eight groups, those that :: stands for with them."""
        both = F.struct(_groups(halves[0]).alias("l"), _groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))).alias("r"), F.size(halves).alias("n"))

        def filled(b: Column) -> Column:
            missing = 8 - F.size(b["l"]) - F.size(b["r"])
            return F.when(b["n"] == 1, b["l"]).when((b["n"] == 2) & (missing >= 1), F.concat(b["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), b["r"]))

        return let(both, filled)

    def digits(groups: Column) -> Column:
        good = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ""))

    low = F.lower(F.regexp_replace(s, "%[^%]+$", ""))
    return F.when(F.contains(s, F.lit(":")), let(let(let(let(low, plain), lambda p: F.split(p, "::", -1)), every), digits))


def address_key(s: Column) -> Column:
    """4 or 6 and the address's hexadecimal digits: keys order as addresses of their kind do. Null for what is no address."""
    four = lambda x: F.concat(F.lit("4"), F.lpad(F.hex(ipv4_number(x)), 8, "0"))
    return let(s, lambda x: F.coalesce(four(x), F.concat(F.lit("6"), F.lower(ipv6_digits(x)))))


def is_address(s: Column) -> Column:
    return address_key(s).isNotNull()


def _held(key: Column, networks: list[str]) -> Column:
    inside = F.lit(False)
    for n in (ipaddress.ip_network(n, strict=False) for n in networks):
        digits = 8 if n.version == 4 else 32
        low, high = (f"{n.version}{int(a):0{digits}X}" for a in (n.network_address, n.broadcast_address))
        inside = inside | F.lower(key).between(low.lower(), high.lower())
    return F.coalesce(inside, F.lit(False))


def in_networks(address: Column, networks: list[str]) -> Column:
    """Whether some network holds the address, IPv4 or IPv6; malformed or null addresses are in none. All inside Catalyst."""
    return let(address_key(address), lambda key: _held(key, networks))


def client_ip(peer: Column, forwarded_for: Column, trusted: list[str]) -> Column:
    """The client that a trusted peer speaks for: going back through the hops, the first that isn't trusted, or the peer if one that is no
    address comes before; the first hop if all are trusted. The peer itself if it isn't trusted or there are no hops."""
    named = F.filter(F.transform(F.split(F.coalesce(forwarded_for, F.lit("")), ","), lambda h: F.btrim(h)), lambda h: h != "")
    keyed = F.transform(named, lambda h: F.struct(h.alias("hop"), address_key(h).alias("key")))

    def client(hops: Column) -> Column:
        stop = F.try_element_at(F.filter(F.reverse(hops), lambda h: h["key"].isNull() | ~_held(h["key"], trusted)), F.lit(1))
        return let(stop, lambda s: F.when(s.isNull(), F.try_element_at(hops, F.lit(1))["hop"]).when(s["key"].isNotNull(), s["hop"]))

    return F.when(in_networks(peer, trusted), F.coalesce(let(keyed, client), peer)).otherwise(peer)
