"""Which hosts a URL may name: special-purpose address blocks, local names, schemes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediacat.functions.conditions import as_col, let, lowered
from mediacat.functions.url import host, is_url, scheme

# The IPv4 special-purpose registry (block, reachable from outside), and multicast.
IPV4_BLOCKS = (
    ("0.0.0.0/8", False),
    ("10.0.0.0/8", False),
    ("100.64.0.0/10", False),
    ("127.0.0.0/8", False),
    ("169.254.0.0/16", False),
    ("172.16.0.0/12", False),
    ("192.0.0.0/24", False),
    ("192.0.0.9/32", True),
    ("192.0.0.10/32", True),
    ("192.0.2.0/24", False),
    ("192.88.99.0/24", False),
    ("192.168.0.0/16", False),
    ("198.18.0.0/15", False),
    ("198.51.100.0/24", False),
    ("203.0.113.0/24", False),
    ("240.0.0.0/4", False),
)
MULTICAST = "224.0.0.0/4"
LOCAL_NAMES = ("localhost", "ip6-localhost", "ip6-loopback")


def _block(cidr: str) -> tuple[int, int]:
    address, length = cidr.split("/")
    a, b, c, d = (int(x) for x in address.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d, int(length)


def blocks_table(spark: SparkSession) -> DataFrame:
    """The registry as rows ``(prefix_len, prefix, cidr, public)``; ``prefix`` holds the leading bits as a number."""
    rows = []
    for cidr, public in IPV4_BLOCKS:
        start, length = _block(cidr)
        rows.append((length, start >> (32 - length), cidr, public))
    return spark.createDataFrame(rows, "prefix_len int, prefix long, cidr string, public boolean")


def _within(ip: Column, cidr: str) -> Column:
    start, length = _block(cidr)
    return ip.between(start, start + (1 << (32 - length)) - 1)


def blocked_ipv4(ip: Column | str) -> Column:
    """Is the address blocked: multicast, or the longest block that holds it is not public."""
    ip = as_col(ip)
    public = None
    for cidr, reach in sorted(IPV4_BLOCKS, key=lambda b: -_block(b[0])[1]):
        inside = _within(ip, cidr)
        public = F.when(inside, F.lit(reach)) if public is None else public.when(inside, F.lit(reach))
    return _within(ip, MULTICAST) | ~public.otherwise(F.lit(True))


#: Blocks that are broadcast at most, by count; more are joined with salted addresses, in so many shares.
BROADCAST_BLOCKS, SALTS = 100_000, 64

REGISTRY_LENGTHS = tuple(sorted({_block(cidr)[1] for cidr, _ in IPV4_BLOCKS}))


def classify_ip(df: DataFrame, blocks: DataFrame, ip: str = "ip", lengths: Sequence[int] = range(33)) -> DataFrame:
    """Longest-prefix match of addresses (as numbers) against a table of blocks of any size.

    Every distinct address is joined on equality with each of the prefix lengths the table has (``lengths``); there is
    no range join. The blocks are counted, up to a bound: so many or fewer are broadcast, more are copied to ``SALTS``
    shares of the addresses, so that a block that holds most of these is not one task's.
    """
    lengths = F.array(*[F.lit(n) for n in lengths])
    candidates = (
        df.where(F.col(ip).isNotNull())
        .select(ip)
        .distinct()
        .select(ip, F.explode(lengths).alias("prefix_len"))
        .withColumn("prefix", F.floor(F.col(ip) / F.pow(F.lit(2.0), 32 - F.col("prefix_len"))).cast("long"))
    )
    if blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        hits = candidates.join(F.broadcast(blocks), ["prefix_len", "prefix"])
    else:
        salted = candidates.withColumn("_salt", F.pmod(F.xxhash64(ip), F.lit(SALTS)))
        copies = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        hits = salted.join(copies, ["prefix_len", "prefix", "_salt"])
    best = hits.groupBy(ip).agg(F.max_by(F.struct("cidr", "public"), "prefix_len").alias("_b"))
    joined = df.join(best, ip, "left")
    blocked = _within(F.col(ip), MULTICAST) | ~F.coalesce(F.col("_b.public"), F.lit(True))
    return joined.select(*df.columns, F.col("_b.cidr").alias("block"), blocked.alias("blocked"))


def _part(text: Column) -> Column:
    """A number of a host name as browsers read it: decimal, octal with a leading 0, hexadecimal with 0x."""
    hexa = F.regexp_extract(text, "^0[xX]([0-9a-fA-F]*)$", 1)
    return (
        F.when(text.rlike("^0[xX][0-9a-fA-F]{0,8}$"), F.coalesce(F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("long"), F.lit(0)))
        .when(text.rlike("^0[0-7]{0,11}$"), F.conv(text, 8, 10).cast("long"))
        .when(text.rlike("^[1-9][0-9]{0,9}$"), text.cast("long"))
    )


def ipv4_number(host_name: Column | str) -> Column:
    """The address a host names in any IPv4 spelling (``10.0.0.1``, ``0x7f.1``, ``2130706433``); else NULL."""
    h = F.regexp_replace(as_col(host_name), r"\.$", "")
    numbers = F.transform(F.split(h, r"\."), _part)
    return F.when(h.rlike(r"^[0-9a-fA-FxX.]+$"), let(numbers, _address))


def _address(numbers: Column) -> Column:
    n = F.size(numbers)
    at = [F.get(numbers, F.lit(i)) for i in range(4)]
    value = None
    for count in range(1, 5):
        lead = F.lit(0).cast("long")
        valid = at[count - 1] < (1 << (8 * (5 - count)))
        for i in range(count - 1):
            lead = lead + at[i] * (1 << (8 * (3 - i)))
            valid = valid & (at[i] < 256)
        whole = F.when(valid, lead + at[count - 1])
        value = F.when(n == count, whole) if value is None else value.when(n == count, whole)
    return value


def ipv6_hex(host_name: Column | str) -> Column:
    """The 32 hex digits of an IPv6 address, in brackets or not; else NULL."""
    h = lowered(F.regexp_replace(as_col(host_name), r"^\[|\]$", ""))
    return F.when(h.contains(":"), let(let(h, _hex_groups), _expanded))


def _hex_groups(h: Column) -> Column:
    """An IPv4 address at the end in two hexadecimal groups."""
    tail = F.regexp_extract(h, r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1)
    groups = let(
        ipv4_number(tail),
        lambda v: F.concat(F.lower(F.hex(F.floor(v / 65536))), F.lit(":"), F.lower(F.hex(v % 65536))),
    )
    return F.when(tail == "", h).otherwise(F.concat(F.substring(h, F.lit(1), F.length(h) - F.length(tail)), groups))


def _expanded(plain: Column) -> Column:
    halves = F.split(plain, "::")

    def groups(i: int) -> Column:
        return F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda g: g != "")

    left, right = groups(0), groups(1)
    missing = F.lit(8) - F.size(left) - F.size(right)
    short = plain.contains("::") & (missing >= 1)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.when(short, missing).otherwise(F.lit(0))), right)
    text = F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), "")
    ok = plain.rlike("^[0-9a-f:]+$") & plain.contains(":") & (F.size(halves) <= 2) & (short | (missing == 0))
    ok = ok & ~plain.rlike("[0-9a-f]{5}|:::|(^|[^:]):$|^:[^:]")
    return F.when(ok & (F.length(text) == 32), text)


def _v4_at(digits: Column, start: int) -> Column:
    return F.conv(F.substring(digits, start + 1, 8), 16, 10).cast("long")


def blocked_ipv6(digits: Column | str) -> Column:
    """Loopback, unspecified, multicast, unique local, link local, or one that carries a blocked IPv4 address."""
    return let(as_col(digits), _blocked_digits)


def _blocked_digits(d: Column) -> Column:
    zeros = "0" * 24
    local = (
        (d == "0" * 31 + "1")
        | (d == "0" * 32)
        | d.startswith("ff")
        | d.rlike("^f[cd]")
        | d.rlike("^fe[89ab]")
    )
    teredo = d.startswith("20010000")
    # Compatible and mapped, NAT64, 6to4, Teredo server, Teredo client (all bits inverted).
    mapped = d.startswith(zeros) | d.startswith("0" * 20 + "ffff")
    client = F.lit(0xFFFFFFFF).cast("long") - _v4_at(d, 24)
    embedded = (
        ((mapped | d.startswith("0064ff9b" + "0" * 16)) & let(_v4_at(d, 24), blocked_ipv4))
        | (d.startswith("2002") & let(_v4_at(d, 4), blocked_ipv4))
        | (teredo & (let(_v4_at(d, 8), blocked_ipv4) | let(client, blocked_ipv4)))
    )
    return local | embedded


def classify_ipv6(df: DataFrame, address: str = "address") -> DataFrame:
    staged = df.withColumn("digits", ipv6_hex(address))
    return staged.withColumn("blocked", blocked_ipv6("digits"))


def private_host(host_name: Column | str) -> Column:
    h = F.regexp_replace(lowered(as_col(host_name)), r"\.+$", "")
    return let(F.regexp_replace(h, r"^\[|\]$", ""), _private)


def _private(bare: Column) -> Column:
    named = bare.isin(*LOCAL_NAMES) | bare.startswith("localhost.") | bare.rlike(r"\.(local|internal)$")
    v4, v6 = let(ipv4_number(bare), blocked_ipv4), let(ipv6_hex(bare), blocked_ipv6)
    return named | F.coalesce(v4, F.lit(False)) | F.coalesce(v6, F.lit(False))


def url_safety(url: Column | str, max_bytes: int | None = None) -> Column:
    """Why a URL must not be fetched: ``too_long`` (with ``max_bytes``), ``invalid``, ``scheme``, ``private_host``; NULL if it may."""
    return let(as_col(url), lambda u: _unsafe_reason(u, max_bytes))


#: A web address whose host is a dotted name that ends in letters, and so neither an address nor a local name.
_NAMED_HOST = r"^https?://(?!localhost\.)(?:[a-z0-9_-]{1,63}\.){1,9}(?!(?:local|internal)(?:[/?]|\z))[a-z]{2,63}(?:[/?][^#]*)?\z"


def _unsafe_reason(u: Column, max_bytes: int | None) -> Column:
    plain = u.rlike(_NAMED_HOST)
    if max_bytes is not None:
        plain = plain & (F.octet_length(u) <= max_bytes)
    return F.when(plain, F.lit(None)).otherwise(let(host(u), lambda h: _reason(u, h, max_bytes)))


def _reason(u: Column, h: Column, max_bytes: int | None) -> Column:
    return (
        F.when(F.lit(False) if max_bytes is None else F.octet_length(u) > max_bytes, "too_long")
        .when(~is_url(u), "invalid")
        .when(~scheme(u).isin("http", "https"), "scheme")
        .when(h.isNull(), "invalid")
        .when(private_host(h), "private_host")
    )
