"""IP address columns: strict parsing, private and loopback tests. No UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUP = "[0-9a-fA-F]{1,4}"
_TAIL = f"(?:{_GROUP}:{_GROUP}|{_IPV4})"


def _ipv6_pattern() -> str:
    """The address grammar of RFC 3986: a full form, or one ``::`` that stands for at least one group."""
    forms = [f"(?:{_GROUP}:){{6}}{_TAIL}"]
    for before in range(0, 6):
        left = f"(?:(?:{_GROUP}:){{0,{before - 1}}}{_GROUP})?" if before else ""
        forms.append(f"{left}::(?:{_GROUP}:){{{5 - before}}}{_TAIL}")
    forms.append(f"(?:(?:{_GROUP}:){{0,5}}{_GROUP})?::{_GROUP}")
    forms.append(f"(?:(?:{_GROUP}:){{0,6}}{_GROUP})?::")
    return "(?:" + "|".join(f"(?:{form})" for form in forms) + ")"


IPV4_PATTERN = rf"\A{_IPV4}\z"
IPV6_PATTERN = rf"\A{_ipv6_pattern()}\z"

# Private and loopback networks, as prefixes of a dotted quad and of its two hex groups.
_QUAD_LOCAL = r"(?:10|127|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."
_HEX_LOCAL = r"(?:0?a[0-9a-f]{2}|7f[0-9a-f]{2}|c0a8|ac1[0-9a-f]):"
IPV4_LOCAL = rf"\A{_QUAD_LOCAL}"
IPV6_LOCAL = (
    r"(?i)\A(?:f[cd][0-9a-f]{2}:"
    r"|[0:]+:(?:0{0,3}1|0\.0\.0\.1)\z"
    rf"|[0:]+:ffff:(?:{_QUAD_LOCAL}[0-9.]+|{_HEX_LOCAL}[0-9a-f]+)\z)"
)


def ipv4_number(ip: Column) -> Column:
    """The 32-bit value of a dotted quad as bigint, null for anything else."""
    parts = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for position in range(4):
        number = number * 256 + F.try_element_at(parts, F.lit(position + 1)).cast("bigint")
    return F.when(ip.rlike(IPV4_PATTERN), number)


def is_private_or_loopback(ip: Column) -> Column:
    """True / false for a valid address, null for anything else. Mapped IPv4 counts as IPv4."""
    return F.when(ip.rlike(IPV4_PATTERN), ip.rlike(IPV4_LOCAL)).when(ip.rlike(IPV6_PATTERN), ip.rlike(IPV6_LOCAL))


def ip_point(ip: Column) -> Column:
    """An address as ``(hi, lo)``, the halves of its 128 bits, each shifted so that points order as signed numbers; null
    for anything else. IPv4 is its mapped IPv6 address. Every step names the one before it once or twice, so the
    expression stays small; the 32 digits are bound to a variable before they are cut."""
    four = ipv4_number(ip)
    tail = F.substring_index(ip, ":", -1)

    def two_groups(octets: Column) -> Column:
        number = [F.get(octets, i).try_cast("int") for i in range(4)]
        return F.concat(F.hex(number[0] * 256 + number[1]), F.lit(":"), F.hex(number[2] * 256 + number[3]))

    # A dotted tail gives way to two groups.
    dotted = F.concat(F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), F.get(F.transform(F.array(F.split(tail, r"\.")), two_groups), 0))
    text = F.concat(F.lit(":"), F.when(F.contains(tail, F.lit(".")), dotted).otherwise(ip))
    # Groups take four digits each and lose the colon before them; colons that are left stand for the groups left out.
    padded = F.regexp_replace(F.regexp_replace(text, ":(?=[0-9a-fA-F])", ":000"), ":0{0,3}([0-9a-fA-F]{4})(?=:|$)", "$1")

    def digits(s: Column) -> Column:
        return F.regexp_replace(s, F.lit(":+"), F.repeat(F.lit("0"), F.lit(32) - F.length(F.replace(s, F.lit(":"), F.lit("")))))

    def half(s: Column, first: int) -> Column:
        upper, lower = (F.conv(F.substring(s, first + skip, 8), 16, 10).cast("bigint") for skip in (0, 8))
        return F.shiftleft(upper, 32).bitwiseOR(lower).bitwiseXOR(F.lit(-(1 << 63)))

    mapped = F.struct(F.lit(-(1 << 63)).alias("hi"), (four + (0xFFFF << 32)).bitwiseXOR(F.lit(-(1 << 63))).alias("lo"))
    six = F.transform(F.transform(F.array(padded), digits), lambda s: F.struct(half(s, 1).alias("hi"), half(s, 17).alias("lo")))
    return F.when(four.isNotNull(), mapped).when(ip.rlike(IPV6_PATTERN), F.get(six, 0))
