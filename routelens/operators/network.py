"""IPv4 and IPv6 subnets: target expansion and attribution of traffic.

An address is a struct (v, hi, lo): the version and its 128 bits as two longs with their first bit flipped, so that structs
compare as addresses do.  Nets never overlap in part: of two, one lies in the other or they share nothing.  Their ends cut each
address space into segments, each with its most specific net, so an address needs one lookup, of the last segment that starts
before it; what it adds to that net is then added to the nets around it, net by net.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.plans.shared import as_of_lookup, is_small, materialize

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_MIXED = rf"^(.*:)((?:{_OCTET}\.){{3}}{_OCTET})$"
_FLIP = -(2**63)
_ADDRESS = "struct<v:int,hi:bigint,lo:bigint>"
#: Subnets with more addresses stay unexpanded.
MOST_HOSTS = 2**32


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 -> integer; NULL for anything else."""
    octets = F.transform(F.split(F.when(ip.rlike(_IPV4), ip), r"\."), lambda x: x.cast("bigint"))
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda total, octet: total * 256 + octet)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _ipv6_halves(ip: Column) -> Column:
    """IPv6 text -> array of its two halves as 16 hex digits each; NULL for anything else."""

    def without_dots(plain: Column) -> Column:
        tail = ip_number(F.regexp_extract(plain, _MIXED, 2))
        number = lambda t: F.concat(F.lower(F.hex(F.shiftright(t, 16))), F.lit(":"), F.lower(F.hex(t.bitwiseAND(65535))))
        dotted = F.concat(F.regexp_extract(plain, _MIXED, 1), _let(tail, number))
        return F.when(F.contains(plain, F.lit(".")), F.coalesce(dotted, plain)).otherwise(plain)

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def filled(parts: Column, abbreviated: Column) -> Column:
        left, right = parts[0], parts[1]
        known = F.size(left) + F.size(right)
        fits = F.when(abbreviated, known <= 7).otherwise(known == 8)
        return F.when(fits, F.concat(left, F.array_repeat(F.lit("0"), 8 - known), right))

    def halves(text: Column) -> Column:
        parts = F.split(text, "::")
        both = F.array(groups(F.get(parts, F.lit(0))), groups(F.get(parts, F.lit(1))))
        return F.when(F.size(parts) <= 2, _let(both, lambda x: filled(x, F.size(parts) == 2)))

    def digits(whole: Column) -> Column:
        valid = F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        text = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(valid, _let(text, lambda t: F.array(F.substring(t, 1, 16), F.substring(t, 17, 16))))

    plain = F.lower(F.regexp_replace(ip, "%[^%/]+$", ""))
    return F.when(F.contains(ip, F.lit(":")), _let(_let(_let(plain, without_dots), halves), digits))


def _struct(v: Column, hi: Column, lo: Column) -> Column:
    return F.struct(v.cast("int").alias("v"), hi.alias("hi"), lo.alias("lo"))


def address(ip: Column) -> Column:
    """Text of an address -> (v, hi, lo), in the order of addresses; NULL for anything else.  Zones are left out."""
    long = lambda x: F.conv(x, 16, -10).cast("bigint").bitwiseXOR(F.lit(_FLIP))
    four = _let(ip_number(ip), lambda n: F.when(n.isNotNull(), _struct(F.lit(4), F.lit(_FLIP), n.bitwiseXOR(F.lit(_FLIP)))))
    six = _let(_ipv6_halves(ip), lambda h: F.when(h.isNotNull(), _struct(F.lit(6), long(h[0]), long(h[1]))))
    return F.coalesce(four, six)


def ip_text(at: Column) -> Column:
    """(v, hi, lo) -> text, IPv6 in its short form."""
    hi, lo = (at[c].bitwiseXOR(F.lit(_FLIP)) for c in ("hi", "lo"))
    octets = [F.shiftright(lo, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    groups = [F.lower(F.hex(F.shiftright(half, s).bitwiseAND(65535))) for half in (hi, lo) for s in (48, 32, 16, 0)]

    def shortened(plain: Column) -> Column:
        short = plain
        for n in range(2, 9):  # the longest run of zero groups, the first of equals
            run = ":" + "0:" * n
            before, after = F.substring_index(plain, run, 1), F.substring(plain, F.instr(plain, run) + len(run), F.lit(99))
            short = F.when(F.contains(plain, F.lit(run)), F.concat(before, F.lit("::"), after)).otherwise(short)
        return short

    whole = _let(F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":")), shortened)
    six = F.regexp_replace(whole, "^:(?!:)|(?<!:):$", "")
    return F.when(at["v"] == 4, F.concat_ws(".", *octets)).otherwise(six)


def _mask(bits: Column) -> Column:
    """A long whose first ``bits`` bits are set."""
    return F.when(bits <= 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("bigint"), 64 - F.least(bits, F.lit(64))))


def _masks(at: Column, prefix: Column) -> tuple[Column, Column]:
    """What a prefix keeps of the two longs of an address."""
    bits = F.when(at["v"] == 4, prefix + 96).otherwise(prefix)
    return _mask(bits), _mask(bits - 64)


def network(at: Column, prefix: Column) -> Column:
    """The first address of an address's net."""
    hi, lo = _masks(at, prefix)
    flip = F.lit(_FLIP)
    return _struct(at["v"], at["hi"].bitwiseXOR(flip).bitwiseAND(hi).bitwiseXOR(flip), at["lo"].bitwiseXOR(flip).bitwiseAND(lo).bitwiseXOR(flip))


def broadcast_address(at: Column, prefix: Column) -> Column:
    """The last address of an address's net."""
    flip, (hi, lo) = F.lit(_FLIP), _masks(at, prefix)
    last = lambda c, mask: at[c].bitwiseXOR(flip).bitwiseOR(F.bitwise_not(mask)).bitwiseXOR(flip)
    return _struct(at["v"], last("hi", hi), last("lo", lo))


def _after(at: Column) -> Column:
    """The next address; NULL after the last one of its space."""
    top, carry = F.lit(2**63 - 1), at["lo"] == 2**63 - 1
    hi = at["hi"] + F.when(carry & (at["hi"] < top), 1).otherwise(0)
    lo = F.when(carry, F.lit(_FLIP)).otherwise(at["lo"] + F.when(carry, 0).otherwise(1))
    last = F.when(at["v"] == 4, at["lo"] == _FLIP + 2**32 - 1).otherwise(carry & (at["hi"] == top))
    return F.when(~last, _struct(at["v"], hi, lo))


def parse_targets(targets: DataFrame) -> DataFrame:
    """``target`` texts as ``(target, prefix, network)``; host names have NULLs.

    A bare address is a net of its own and host bits are masked off.  IPv4 nets may have a netmask or a host mask in place of
    the prefix length.
    """
    part = F.split("target", "/")
    at = address(F.get(part, F.lit(0)))
    width = F.when(at["v"] == 4, 32).otherwise(128)
    given = F.get(part, F.lit(1))
    mask = ip_number(given)
    net_mask = (mask == 0) | (mask >= 2**31)
    ones = F.when(net_mask, mask).otherwise(mask.bitwiseXOR(F.lit(2**32 - 1)))  # a host mask is its complement
    length = F.bit_count(ones).cast("int")
    solid = ones == F.lit(2**32) - F.pow(F.lit(2), 32 - length).cast("bigint")
    masked = F.when((at["v"] == 4) & solid, length)
    prefix = F.when(given.isNull(), width).when(given.rlike("^[0-9]{1,9}$"), given.try_cast("int")).otherwise(masked)
    valid = at.isNotNull() & prefix.between(0, width) & (F.size(part) <= 2)
    rows = targets.select("target", F.when(valid, at).alias("at"), F.when(valid, prefix).alias("prefix"))
    return rows.select("target", "prefix", F.when(F.col("at").isNotNull(), network(F.col("at"), F.col("prefix"))).alias("network"))


def expand_targets(targets: DataFrame) -> DataFrame:
    """``(target, host)``: every usable host address of a subnet; other targets stay as they are.

    The first and last address are left out for IPv4 nets of /30 and wider, the first for IPv6 nets of /126 and wider.  IPv6 nets
    of more than 2**32 addresses stay as they are.  Addresses are generated in two steps, blocks and then addresses, so no row
    ever holds more than 65,536 numbers.
    """
    nets = parse_targets(targets)
    v, bits = F.col("network.v"), F.when(F.col("network.v") == 4, 32).otherwise(128) - F.col("prefix")
    nets = nets.withColumn("size", F.when(bits <= 32, F.pow(F.lit(2), bits).cast("bigint")))
    skip_first = F.when(bits > 1, 1).otherwise(0)
    skip_last = F.when((bits > 1) & (v == 4), 1).otherwise(0)
    ranges = nets.filter("size is not null").select(
        "target", "network.v", "network.hi", (F.col("network.lo") + skip_first).alias("lo"), (F.col("network.lo") + (F.col("size") - 1) - skip_last).alias("last")
    )
    blocks = ranges.select(
        "target", "v", "hi", "lo", "last", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("last", 16))).alias("block")
    ).repartition("target", "block")
    start = F.greatest("lo", F.col("block") * 65536)
    end = F.least("last", F.col("block") * 65536 + 65535)
    numbers = blocks.select("target", "v", "hi", F.explode(F.sequence(start, end)).alias("lo"))
    hosts = numbers.select("target", ip_text(F.struct("v", "hi", "lo")).alias("host"))
    return hosts.unionByName(nets.filter("size is null").select("target", F.col("target").alias("host")))


def _around(points: DataFrame, nets: DataFrame) -> DataFrame:
    """``points`` (at, ...) with the prefix and net of each net they lie in: one candidate per prefix length in use."""
    lengths = nets.select(F.col("first.v").alias("v"), "prefix").distinct()
    offered = points.join(F.broadcast(lengths), F.col("at.v") == F.col("v")).drop("v")  # at most 162 lengths
    of = nets.select(F.col("first").alias("_first"), F.col("prefix").alias("_prefix"), F.col("net").alias("around"))
    return offered.join(of, (network(F.col("at"), F.col("prefix")) == F.col("_first")) & (F.col("prefix") == F.col("_prefix"))).drop("_first", "_prefix")


def segments(nets: DataFrame) -> DataFrame:
    """``(at, net)``: from each address on, up to the next, the most specific net; NULL where there is none.

    ``nets`` is (net, first, prefix), written.
    """
    ends = F.array(F.col("first"), _after(broadcast_address(F.col("first"), F.col("prefix"))))
    points = nets.select(F.explode(ends).alias("at")).filter("at is not null").distinct()
    inside = _around(points, nets).groupBy("at").agg(F.max_by("around", "prefix").alias("net"))
    return points.join(inside, "at", "left").select("at", "net")


def _keys(v, hi, lo) -> np.ndarray:
    """17 bytes per address that compare as addresses do."""
    out = np.zeros((len(v), 17), np.uint8)
    out[:, 0] = v
    for i, half in ((1, hi), (9, lo)):
        flipped = (np.asarray(half, np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8")
        out[:, i : i + 8] = flipped.view(np.uint8).reshape(-1, 8)
    return out.view("S17").reshape(-1)


def _looked_up(starts, nets):
    def run(batches):
        for batch in batches:
            at = batch.column(batch.schema.names.index("at"))
            keys = _keys(*(at.field(c).to_numpy(zero_copy_only=False) for c in ("v", "hi", "lo")))
            place = np.searchsorted(starts.value, keys, "right") - 1
            found = np.where(place >= 0, nets.value[np.maximum(place, 0)], -1) if nets.value.size else np.full(len(keys), -1)
            net = pa.array(found, pa.int64(), mask=found < 0)
            kept = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in kept), net], names=[*kept, "net"])

    return run


def net_of(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """``rows`` with ``net``, that of the segment their address ``at`` lies in, in place of ``at``.  ``segments`` is written.

    A table of segments that is measured to be small is sorted once and looked up by bisection in tasks; a larger one meets the
    addresses in a sort over the cluster.
    """
    if not is_small(segments):
        return as_of_lookup(rows, segments, "at", "net").drop("at")
    table = segments.select("at.v", "at.hi", "at.lo", F.coalesce("net", F.lit(-1)).alias("net")).toPandas()
    keys = _keys(table["v"], table["hi"], table["lo"])
    order = np.argsort(keys)
    context = rows.sparkSession.sparkContext
    starts, nets = context.broadcast(keys[order]), context.broadcast(table["net"].to_numpy(np.int64)[order])
    kept = [f for f in rows.schema.fields if f.name != "at"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(_looked_up(starts, nets), f"{fields}, net bigint")


def attribute_subnets(traffic: DataFrame, subnets: DataFrame) -> DataFrame:
    """Calls, errors and distinct addresses per registered subnet that has any; an address counts in every net it lies in.

    Addresses are combined first and looked up once each.
    """
    per_ip = traffic.filter("source_ip is not null").groupBy("source_ip").agg(
        F.count("*").alias("calls"), F.count_if(F.col("status_code") >= 400).alias("errors")
    )
    per_ip = per_ip.select("calls", "errors", address(F.col("source_ip")).alias("at")).filter("at is not null")
    targets = materialize(parse_targets(subnets).filter("network is not null").distinct(), "targets")
    nets = targets.select(F.col("network").alias("first"), "prefix").distinct().withColumn("net", F.monotonically_increasing_id())
    nets = materialize(nets, "nets")
    own = net_of(per_ip, materialize(segments(nets), "segments")).filter("net is not null").groupBy("net").agg(
        F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.count("*").alias("addresses")
    )
    inner = nets.select("net", F.col("first").alias("at"), F.col("prefix").alias("own_prefix"))
    around = _around(inner, nets).filter("prefix <= own_prefix").select("net", "around")
    sums = own.join(around, "net").groupBy("around").agg(*[F.sum(c).alias(c) for c in ("calls", "errors", "addresses")])
    out = sums.join(nets, F.col("around") == F.col("net")).select(F.col("first").alias("network"), "prefix", "calls", "errors", "addresses")
    return targets.join(out, ["network", "prefix"]).select("target", "calls", "errors", "addresses")
