"""URLs as Column expressions: validity, normal form, identity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.constants import MEETUP_TRACKING_KEYS, TRACKING_KEYS, TRACKING_PREFIX

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(_part(url, 2), r"^.*@", ""), r":\d*$", ""), r"\.+$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(_part(url, 2), r":(\d+)$", 1)


def path(url: Column) -> Column:
    return F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))


def query(url: Column) -> Column:
    return _part(url, 4)


def fragment(url: Column) -> Column:
    return _part(url, 5)


def is_public_ipv4(address: Column) -> Column:
    """Whether a dotted IPv4 address is globally reachable; null where it is none."""
    octets = [F.regexp_extract(address, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", i).try_cast("int") for i in range(1, 5)]
    a, b, c, _ = octets
    private = (
        a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    )
    ok = F.lit(True)
    for o in octets:
        ok = ok & o.isNotNull() & (F.coalesce(o, F.lit(999)) <= 255)
    return F.when(ok, ~private)


# IPv6 networks by their first groups and lengths. Inside 2000::/3 addresses are public but for CLOSED, and in
# CLOSED those of OPENED are. Outside it only the old site-local network counts as public, so mapped IPv4 addresses never do.
OPEN6 = (("2000", 3), ("fec0", 10))
CLOSED6 = (("2001", 23), ("2001:db8", 32), ("2002", 16))
OPENED6 = (("2001:1:0:0:0:0:0:1", 128), ("2001:1:0:0:0:0:0:2", 128), ("2001:3", 32), ("2001:4:112", 48), ("2001:20", 28), ("2001:30", 28))


def _once(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.transform(F.array(x), then)[0]


def _hex_tail(address: Column) -> Column:
    """The address with a dotted IPv4 end written as two groups; null where the end is no address."""
    octets = F.transform(F.split(F.regexp_extract(address, r"([0-9.]*)$", 1), r"\."), lambda o: o.try_cast("int"))
    group = lambda o, i: F.hex(o[i] * 256 + o[i + 1])
    joined = _once(octets, lambda o: F.when((F.size(o) == 4) & F.forall(o, lambda x: x.between(0, 255)), F.concat(group(o, 0), F.lit(":"), group(o, 2))))
    return F.when(~address.contains("."), address).when(address.rlike(r":\d{1,3}(?:\.\d{1,3}){3}$"), F.concat(F.regexp_replace(address, r"[\d.]+$", ""), joined))


def ipv6_groups(address: Column) -> Column:
    """The eight numbers of an IPv6 address without brackets; null where it is none. Its end may be a dotted IPv4 address."""

    def side(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(ends: Column) -> Column:
        gap = F.lit(8) - F.size(ends["head"]) - F.size(ends["rest"])
        return F.when(ends["n"] == 1, ends["head"]).when((ends["n"] == 2) & (gap >= 1), F.concat(ends["head"], F.array_repeat(F.lit("0"), gap), ends["rest"]))

    def numbers(groups: Column) -> Column:
        sound = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(sound, F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))

    parted = _once(F.split(_once(address, _hex_tail), "::", 3), lambda s: F.struct(F.size(s).alias("n"), side(s[0]).alias("head"), side(F.element_at(s, -1)).alias("rest")))
    return _once(_once(parted, filled), numbers)


def _networks(networks: tuple[tuple[str, int], ...]) -> Column:
    """Networks as an array of (first, mask), eight numbers each."""

    def eight(numbers: list[int]) -> str:
        return f"array({', '.join(map(str, numbers))})"

    rows = []
    for text, length in networks:
        first = ([int(x, 16) for x in text.split(":")] + [0] * 8)[:8]
        mask = [0xFFFF & ~(0xFFFF >> max(0, min(16, length - 16 * i))) for i in range(8)]
        rows.append(f"struct({eight([f & m for f, m in zip(first, mask, strict=True)])} AS first, {eight(mask)} AS mask)")
    return F.expr(f"array({', '.join(rows)})")


def is_public_ipv6(address: Column) -> Column:
    """Whether an IPv6 address is globally reachable; null where it is none."""

    def judged(g: Column) -> Column:
        among = lambda nets: F.exists(_networks(nets), lambda n: F.forall(F.arrays_zip(g.alias("g"), n["first"].alias("f"), n["mask"].alias("m")), lambda z: z["g"].bitwiseAND(z["m"]) == z["f"]))
        return F.when(g.isNotNull(), among(OPEN6) & (~among(CLOSED6) | among(OPENED6)))

    return _once(ipv6_groups(address), judged)


def is_public_ip(address: Column) -> Column:
    """Either kind of address; null where it is none."""
    return F.coalesce(is_public_ipv4(address), is_public_ipv6(address))


def is_valid(url: Column) -> Column:
    """HTTP(S) with a host, without credentials, not local; an address must be public."""

    def named(h: Column) -> Column:
        bracketed = F.when(h.startswith("["), F.coalesce(is_public_ipv6(F.regexp_extract(h, r"^\[(.*)\]$", 1)), F.lit(False))).otherwise(True)
        return (h != "") & (h != "localhost") & ~h.endswith(".localhost") & F.coalesce(is_public_ipv4(h), F.lit(True)) & bracketed

    net = _part(url, 2)
    return F.coalesce(scheme(url).isin("http", "https") & ~net.contains("@") & F.regexp_extract(net, r":([^:\]]*)$", 1).rlike(r"^\d*$") & _once(host(url), named), F.lit(False))


def _kept(q: Column, keys: tuple[str, ...], prefix: str | None) -> Column:
    """Parameters whose names are not tracking, in order, encoded anew."""

    def name(p: Column) -> Column:
        return F.lower(F.coalesce(F.try_url_decode(F.split(p, "=", 2)[0]), F.split(p, "=", 2)[0]))

    def keep(p: Column) -> Column:
        ok = (p != "") & ~name(p).isin(*keys)
        return ok & ~name(p).startswith(prefix) if prefix else ok

    def again(p: Column) -> Column:
        parts = F.split(p, "=", 2)
        code = lambda x: F.url_encode(F.coalesce(F.try_url_decode(x), x))
        return F.concat(code(parts[0]), F.lit("="), F.when(F.size(parts) > 1, code(F.element_at(parts, -1))).otherwise(""))

    return F.array_join(F.transform(F.filter(F.split(q, "&"), keep), again), "&")


def _event_route(url: Column) -> Column:
    ok = (scheme(url) == "https") & (host(url) == "www.nvidia.com") & port(url).isin("", "443") & (path(url) == "/en-us/about-nvidia/webinar-portal/")
    return F.when(ok & fragment(url).rlike(r"^/webinar/[0-9]+$"), fragment(url)).otherwise("")


def _built(url: Column, p: Column, q: Column, frag: Column) -> Column:
    net = F.concat(host(url), F.when(port(url) == "", "").otherwise(F.concat(F.lit(":"), port(url))))
    return F.concat(scheme(url), F.lit("://"), net, p, F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)), F.when(frag == "", "").otherwise(F.concat(F.lit("#"), frag)))


def normalize(url: Column) -> Column:
    """Lower-case host, no tracking parameters, no fragment; null where the url is not valid."""
    return F.when(is_valid(url), _built(url, path(url), _kept(query(url), TRACKING_KEYS, TRACKING_PREFIX), _event_route(url)))


def _meetup(n: Column) -> Column:
    ok = host(n).isin("meetup.com", "www.meetup.com") & path(n).rlike(r"^/(?:[^/]+/)?events/[^/]+/?$")
    return F.when(ok, _built(n, F.regexp_replace(path(n), "/+$", ""), _kept(query(n), MEETUP_TRACKING_KEYS, None), F.lit("")))


def meetup_identity(url: Column) -> Column:
    return _once(normalize(url), _meetup)


def webinar_identity(url: Column) -> Column:
    return _once(normalize(url), lambda n: F.when(_event_route(n) != "", n))


def identity(url: Column) -> Column:
    return F.coalesce(_once(normalize(url), lambda n: F.coalesce(_meetup(n), n)), url)


def same_destination(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (identity(a) == identity(b)), F.lit(False))


def safe_outbound(url: Column) -> Column:
    """The normalised url, if it is valid."""
    return F.when(is_valid(url), normalize(url))


def host_suffixes(h: Column) -> Column:
    """The host and its parent domains: for equi-joins with a list of domains."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_ok(d: Column) -> Column:
    """Syntax of a configured domain."""
    return F.rtrim(F.lower(F.trim(d)), F.lit(".")).rlike(r"^(?=.{1,253}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$")


def pages_of(url: Column, parameter: Column, pages: Column) -> Column:
    """The listing page and its further pages 2..pages."""
    base = F.regexp_replace(url, "#.*$", "")
    glue = F.when(base.contains("?"), "&").otherwise("?")
    more = F.transform(F.sequence(F.lit(2), F.greatest(pages, F.lit(2))), lambda i: F.concat(base, glue, parameter, F.lit("="), i.cast("string")))
    return F.concat(F.array(base), F.when(pages > 1, more).otherwise(F.array().cast("array<string>")))
