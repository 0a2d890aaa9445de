"""Addresses of hosts and networks, and of interfaces. An address is a text such as ``192.168.1.5/24``."""

from __future__ import annotations

import ipaddress
import re

from tessella.functions.base import BOOL, INT, LONG, STRING, rowwise


def _inet(s: str):
    return ipaddress.ip_interface(s)


def _show(i, always: bool = False) -> str:
    full = i.network.prefixlen == i.max_prefixlen
    return str(i.ip) if full and not always else f"{i.ip}/{i.network.prefixlen}"


def _with(i, bits: int):
    return ipaddress.ip_interface(f"{i.ip}/{i.max_prefixlen if bits < 0 else bits}")


def _mask(i, host: bool):
    n = i.network
    return str(n.hostmask if host else n.netmask)


def _merge(a: str, b: str) -> str:
    x, y = _inet(a).network, _inet(b).network
    if x.version != y.version:
        raise ValueError("cannot merge addresses from different families")
    while not (x.supernet_of(y)):
        x = x.supernet()
    return str(x)


def _shift(s: str, n: int) -> str:
    i = _inet(s)
    return _show(ipaddress.ip_interface(f"{i.ip + n}/{i.network.prefixlen}"))


def _bits(f):
    def g(a: str, b: str) -> str:
        x, y = _inet(a), _inet(b)
        out = type(x.ip)(f(int(x.ip), int(y.ip)))
        return _show(ipaddress.ip_interface(f"{out}/{max(x.network.prefixlen, y.network.prefixlen)}"))

    return g


def _within(a: str, b: str, strict: bool) -> bool:
    x, y = _inet(a).network, _inet(b).network
    return x.version == y.version and x.subnet_of(y) and not (strict and x.prefixlen == y.prefixlen)


def _abbrev(s: str, cidr: bool) -> str:
    i = _inet(s)
    if not cidr or i.version == 6:
        return _show(i)
    n, parts = i.network.prefixlen, str(i.ip).split(".")
    return ".".join(parts[: max((n + 7) // 8, 1)]) + f"/{n}"


host = rowwise(lambda s: str(_inet(s).ip), STRING)
text = rowwise(lambda s: _show(_inet(s), True), STRING)
abbrev = rowwise(_abbrev, STRING)
family = rowwise(lambda s: _inet(s).version, INT)
masklen = rowwise(lambda s: _inet(s).network.prefixlen, INT)
netmask = rowwise(lambda s: _mask(_inet(s), False), STRING)
hostmask = rowwise(lambda s: _mask(_inet(s), True), STRING)
network = rowwise(lambda s: str(_inet(s).network), STRING)
broadcast = rowwise(lambda s: _show(ipaddress.ip_interface(f"{_inet(s).network.broadcast_address}/{_inet(s).network.prefixlen}")), STRING)
set_masklen = rowwise(lambda s, n: _show(_with(_inet(s), n)), STRING)
inet_merge = rowwise(_merge, STRING)
inet_same_family = rowwise(lambda a, b: _inet(a).version == _inet(b).version, BOOL)
within = rowwise(lambda a, b: _within(a, b, True), BOOL)  # <<
within_or_equal = rowwise(lambda a, b: _within(a, b, False), BOOL)  # <<=
contains = rowwise(lambda a, b: _within(b, a, True), BOOL)  # >>
contains_or_equal = rowwise(lambda a, b: _within(b, a, False), BOOL)  # >>=
overlaps = rowwise(lambda a, b: _within(a, b, False) or _within(b, a, False), BOOL)  # &&
plus = rowwise(_shift, STRING)
minus = rowwise(lambda a, b: int(_inet(a).ip) - int(_inet(b).ip), LONG)
bit_and = rowwise(_bits(lambda a, b: a & b), STRING)
bit_or = rowwise(_bits(lambda a, b: a | b), STRING)
bit_not = rowwise(lambda s: _show(ipaddress.ip_interface(f"{type(_inet(s).ip)(int(_inet(s).ip) ^ ((1 << _inet(s).max_prefixlen) - 1))}/{_inet(s).network.prefixlen}")), STRING)


def _sort_key(s: str) -> str:
    """Text that sorts as addresses do: family, network bits, length of the mask, all bits."""
    i = _inet(s)
    return f"{i.version}{int(i.network.network_address):040d}{i.network.prefixlen:03d}{int(i.ip):040d}"


sort_key = rowwise(_sort_key, STRING)


def _mac(s: str) -> bytes:
    out = bytes.fromhex(re.sub(r"[^0-9A-Fa-f]", "", s))
    if len(out) not in (6, 8):
        raise ValueError(f"invalid address {s!r}")
    return out


def _mac_text(b: bytes) -> str:
    return ":".join(f"{x:02x}" for x in b)


macaddr = rowwise(lambda s: _mac_text(_mac(s)), STRING)
trunc_macaddr = rowwise(lambda s: _mac_text(_mac(s)[:3] + bytes(len(_mac(s)) - 3)), STRING)
macaddr8 = rowwise(lambda s: _mac_text(_mac(s) if len(_mac(s)) == 8 else _mac(s)[:3] + b"\xff\xfe" + _mac(s)[3:]), STRING)
macaddr8_set7bit = rowwise(lambda s: _mac_text(bytes([_mac(s)[0] | 2]) + (_mac(s)[1:] if len(_mac(s)) == 8 else _mac(s)[1:3] + b"\xff\xfe" + _mac(s)[3:])), STRING)
mac_and = rowwise(lambda a, b: _mac_text(bytes(x & y for x, y in zip(_mac(a), _mac(b)))), STRING)
mac_or = rowwise(lambda a, b: _mac_text(bytes(x | y for x, y in zip(_mac(a), _mac(b)))), STRING)
mac_not = rowwise(lambda a: _mac_text(bytes(x ^ 255 for x in _mac(a))), STRING)
